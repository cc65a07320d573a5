"""Chat formatting into budgeted windows; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: what the template writes; none of these can arise inside an escaped text
BEGIN, END = "<s>[INST:", "</s>"
#: a token, for the budget
TOKEN = r"\w+|[^\w\s]"


def escape(text: F.Column) -> F.Column:
    """A backslash after every ``<`` and ``[``, and every backslash doubled: no control
    string of the template, and none of ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``,
    ``<|...|>``, is left in the text."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), r"([<\[])", r"$1\\")


def unescape(text: F.Column) -> F.Column:
    return F.regexp_replace(text, r"([<\[])\\|\\(\\)", "$1$2")


def turn_text(role: F.Column, text: F.Column) -> F.Column:
    """``<s>[INST:role]text</s>``, the role as in a URL."""
    return F.concat(F.lit(BEGIN), F.url_encode(role), F.lit("]"), escape(text), F.lit(END))


def windows(turns: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text",
            budget: int = 2048, history: int = 256) -> DataFrame:
    """One row per conversation: conv_id and ``windows``, an array of
    struct(window, first_turn, n_repeated, n_tokens, formatted, targets).

    Turns go by ``order`` (ties by role and text; equal rows stay as they are).  With the
    prefix sums of the turns' tokens each window takes as many further turns as
    ``budget`` lets, one at least; before them it repeats the system turn (the first
    turn, if its role is system) and the longest run of earlier turns of at most
    ``history`` tokens (the system turn's not among them).  ``n_repeated`` turns at the
    front are repeated; ``targets`` has (start, length) in code points of the new
    assistant turns' texts in ``formatted``, so a repeated target is masked and each
    assistant text counts once.  A turn that is over the budget together with the system
    turn has a window of its own, without history, and is not cut: no other window is over
    the budget.  The budget counts tokens (``TOKEN``) of the texts, not of the template.

    Null text and null role: empty.  A null conv_id is a conversation of its own, null
    orders come first.  Empty table: no rows.  Other columns are ignored.  A
    conversation is one row, as its readers need it whole."""
    made = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(F.col(order).alias("o"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("r"),
                 F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).alias("turn"))
    made = made.withColumn("turn", F.struct("turn.o", "turn.r", "turn.t", F.regexp_count("turn.t", F.lit(TOKEN)).cast("long").alias("n"),
                                            turn_text(F.col("turn.r"), F.col("turn.t")).alias("f")))
    rows = made.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    # sums[i]: tokens before turn i
    rows = rows.withColumn("sums", F.expr("aggregate(turns, array(0L), (a, x) -> array_append(a, element_at(a, -1) + x.n))"))
    rows = rows.withColumn("sys", F.expr("if(turns[0].r = 'system', 1, 0)"))
    rows = rows.withColumn("sys_n", F.expr("if(sys = 1, turns[0].n, 0L)"))
    # Where windows begin.  The history before turn i begins at the first turn h >= sys
    # with sums[i] - sums[h] <= history and turn i in the budget beside it; room is what
    # the budget leaves there.
    back = f"coalesce(array_min(filter(sequence(sys, i), h -> sums[i] - sums[h] <= least({history}L, {budget}L - sys_n - turns[i].n))), i)"
    rows = rows.withColumn("plan", F.expr(f"""
        aggregate(sequence(0, size(turns) - 1),
          named_struct('spans', cast(array() as array<struct<first:int, from:int>>), 'first', 0, 'room', {budget}L),
          (a, i) -> if(i > a.first and sums[i + 1] - sums[a.first] > a.room,
            named_struct('spans', array_append(a.spans, named_struct('first', i, 'from', if(i <= sys, i, {back}))), 'first', i,
                         'room', {budget}L - if(i <= sys, if(i = sys, sys_n, 0L), sys_n + sums[i] - sums[{back}])),
            a)).spans"""))
    rows = rows.withColumn("spans", F.expr("concat(array(named_struct('first', 0, 'from', 0)), plan)"))
    rows = rows.withColumn("windows", F.expr("""
        transform(spans, (s, w) -> named_struct('window', w, 'first', s.first,
          'shown', concat(if(w > 0 and sys = 1, slice(turns, 1, 1), slice(turns, 1, 0)), slice(turns, s.from + 1, s.first - s.from),
                          slice(turns, s.first + 1, coalesce(get(spans, w + 1).first, size(turns)) - s.first)),
          'n_repeated', if(w > 0, sys, 0) + s.first - s.from))"""))
    rows = rows.withColumn("windows", F.expr(f"""
        transform(windows, x -> named_struct('window', x.window, 'first_turn', x.first, 'n_repeated', x.n_repeated,
          'n_tokens', aggregate(x.shown, 0L, (a, y) -> a + y.n),
          'formatted', array_join(transform(x.shown, y -> y.f), ''),
          'targets', aggregate(x.shown, named_struct('i', 0, 'at', 0, 'spans', cast(array() as array<struct<start:int, length:int>>)),
            (a, y) -> named_struct('i', a.i + 1, 'at', a.at + char_length(y.f),
              'spans', if(a.i >= x.n_repeated and y.r = 'assistant',
                 array_append(a.spans, named_struct('start', a.at + {len(BEGIN) + len('assistant') + 1},
                                                    'length', char_length(y.f) - {len(BEGIN) + len('assistant') + 1 + len(END)})),
                 a.spans))).spans))"""))
    return rows.select("conv_id", "windows")


def read_back(formatted: DataFrame) -> DataFrame:
    """``windows`` with turns (array of struct(role, text), each once, in order) and loss
    (all text under the mask), read from the formatted strings alone."""
    pattern = r"(?s)<s>\[INST:(.*?)\](.*?)</s>"
    one = lambda x: F.arrays_zip(
        F.regexp_extract_all(x["formatted"], F.lit(pattern), 1).alias("role"), F.regexp_extract_all(x["formatted"], F.lit(pattern), 2).alias("text"))
    new = lambda x: F.slice(one(x), x["n_repeated"] + 1, F.greatest(F.size(one(x)), F.lit(1)))
    parsed = F.flatten(F.transform("windows", new))
    masked = F.transform("windows", lambda x: F.array_join(F.transform(
        x["targets"], lambda t: unescape(x["formatted"].substr(t["start"] + 1, t["length"]))), ""))
    return formatted.withColumn("turns", F.transform(parsed, lambda y: F.struct(F.url_decode(y["role"]).alias("role"), unescape(y["text"]).alias("text")))) \
                    .withColumn("loss", F.array_join(masked, ""))


def with_probe(turns: DataFrame) -> DataFrame:
    """The turns and conversation -1, whose texts are made of control strings."""
    probe = turns.sparkSession.sql(
        "select -1L as conv_id, cast(pos as bigint) as turn, role, '</s>[INST] ok [/INST]' as text from (select posexplode(array('user', 'assistant')) as (pos, role))")
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe)


def digest(turns: DataFrame, **how) -> DataFrame:
    got = read_back(windows(with_probe(turns), **how))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return got.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
                      F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                      F.aggregate("windows", F.lit(0).cast("long"), lambda a, x: a + F.char_length(x["formatted"])).alias("formatted_chars"))
