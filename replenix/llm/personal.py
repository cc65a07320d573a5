"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby
move their score.  DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: characters before and after a match in which its context words are looked for
BEFORE, AFTER = 40, 25


@dataclass(frozen=True)
class Rule:
    """What proposes spans of a kind.  The pattern is a Java one without groups that
    capture; every text with a match also matches ``gate``, which is cheap; ``confirm`` is SQL over ``m`` (the match) and ``digits`` (its digits).  A
    confirmed match scores ``prior``, plus ``BONUS`` with a word of ``near`` around it,
    less ``BONUS`` with one of ``NOT_NEAR``.  Matches of a ``base`` rule stay whatever
    their score."""
    kind: str
    gate: str
    pattern: str
    confirm: str
    prior: float
    near: str
    base: bool = False


BONUS = 0.25
#: words that tell of another use of digits
NOT_NEAR = r"isbn|issn|order no|invoice|tracking|version|serial|sku|rechnung|bestellung|facture|commande|factura|pedido"
PHONE_WORDS = r"phone|mobile|cell|call|fax|tel|telefon|handy|anrufen|téléphone|portable|appelez|teléfono|móvil|llame"
CARD_WORDS = r"card|visa|mastercard|amex|credit|debit|karte|kreditkarte|carte|tarjeta"
MAIL_WORDS = r"mail|contact|write to|kontakt|écrire|correo|contacto"

# mod 97 of an IBAN: its first four characters go last, letters count from 10
MOD97 = ("aggregate(split(concat(substr(replace(m, ' ', ''), 5), left(replace(m, ' ', ''), 4)), ''), 0L, (a, c) -> "
         "if(c between '0' and '9', (a * 10 + ascii(c) - 48) % 97, (a * 100 + ascii(c) - 55) % 97)) = 1")

# In the patterns of the base rules the repeats are possessive and a run is entered at its
# front only (or where the match before ended): the same matches as of the plain patterns,
# without stack or quadratic time on long runs.  Card runs of under 12 digits fail anyhow.
RULES = (
    Rule("email", "@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "true", 0.75, MAIL_WORDS, True),
    Rule("ip", r"[0-9]\.[0-9]", r"[0-9](?<![0-9]{2})[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
         "forall(split(m, '[.]'), p -> length(ltrim('0', p)) <= 3 and coalesce(try_cast(ltrim('0', p) as int), 0) <= 255)",
         0.5, r"ip|address|host|server|adresse|dirección|login", True),
    Rule("card", r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", r"[0-9](?:[\x20-]?[0-9]){11,}+", "length(digits) between 12 and 19 and luhn_check(digits)", 0.75, CARD_WORDS, True),
    Rule("phone", r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", "length(digits) between 9 and 15", 0.6, PHONE_WORDS, True),
    # numbers that stand beside others, so that the wide patterns run over their ends
    Rule("card", r"[0-9]{4}[\x20-]?[0-9]{4}", r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9])", "luhn_check(digits)", 0.6, CARD_WORDS),
    Rule("phone", r"\+1", r"\+1[\x20.-]?(?:\([0-9]{3}\)|[0-9]{3})[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])", "true", 0.6, PHONE_WORDS),
    # numbers without a country code need a word that tells
    Rule("phone", r"[0-9]{3}[.-][0-9]{4}", r"(?<![0-9+.-])(?:\([0-9]{3}\)[\x20]?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])", "true", 0.3, PHONE_WORDS),
    Rule("iban", r"[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", MOD97, 0.75,
         r"iban|account|konto|compte|cuenta"),
    Rule("ssn", r"[0-9]-[0-9]{2}-[0-9]", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "true", 0.3, r"ssn|social security|social"),
)
#: the order of kinds that begin at one place
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")


def proposals(text: F.Column) -> F.Column:
    """All matches of all rules in a text: array of struct(rule, at, m, gap, before,
    after), ``at`` the match's number within its rule and ``gap`` the characters between
    it and the match before."""
    return F.concat(*[matches(text, n, rule) for n, rule in enumerate(RULES)])


def matches(text: F.Column, n: int, rule: Rule) -> F.Column:
    # the found texts and those between them, bound to a variable so that each is made once
    both = F.array(F.struct(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("f"), F.split(text, rule.pattern, -1).alias("b")))

    def placed(x: F.Column) -> F.Column:
        beside = F.zip_with(F.slice(x["b"], 1, F.size(x["f"])), F.slice(x["b"], 2, F.size(x["f"])), lambda p, q: F.struct(
            F.char_length(p).cast("long").alias("gap"), F.right(p, F.lit(BEFORE)).alias("before"), F.left(q, F.lit(AFTER)).alias("after")))
        pairs = F.zip_with(x["f"], beside, lambda m, b: F.struct(m.alias("m"), b.alias("b")))
        return F.transform(pairs, lambda y, i: F.struct(
            F.lit(n).alias("rule"), i.alias("at"), y["m"].alias("m"), y["b"]["gap"].alias("gap"), y["b"]["before"].alias("before"), y["b"]["after"].alias("after")))

    each = F.flatten(F.transform(both, placed))
    # the text is cut only where something matches
    return F.coalesce(F.when(text.rlike(rule.gate) & text.rlike(rule.pattern), each), F.array())


def by_rule(pick, otherwise) -> F.Column:
    """A value by the rule's number."""
    out = None
    for n, rule in enumerate(RULES):
        out = F.when(F.col("rule") == n, pick(rule)) if out is None else out.when(F.col("rule") == n, pick(rule))
    return out.otherwise(otherwise)


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: doc_id and ``spans``, an array of struct(start,
    kind_no, end, kind, score, base) by start, then kind as listed in ``KINDS``; code
    points, end exclusive.

    Each rule's pattern is matched leftmost and without overlaps over the whole text;
    what its checksum or form does not confirm is dropped, without another try.  A
    match of a rule that is not a base one stays if its score reaches ``least`` and it
    does not lie inside a base match; equal spans count once, with the higher score.

    A match's place is the running sum of gaps and lengths (a window by row), so time
    and memory are linear in the text; the text itself is not shuffled, only the matches
    and one row for each document.  Null text: empty, no spans.  Null and repeated ids:
    each row has a result of its own.  Empty table: no rows.  Other columns are ignored."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("rid"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    found = rows.select("doc_id", "rid", F.explode_outer(proposals(F.col("t"))).alias("p")).select("doc_id", "rid", "p.*").repartition("rid")
    walk = Window.partitionBy("rid", "rule").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = found.withColumn("end", F.sum(F.col("gap") + F.char_length("m")).over(walk)).withColumn("digits", F.regexp_replace("m", "[^0-9]", ""))
    around = F.lower(F.concat_ws(" \u0001 ", "before", "after"))
    score = by_rule(lambda r: F.lit(r.prior) + F.when(around.rlike(rf"(?U)\b(?:{r.near})"), F.lit(BONUS)).otherwise(F.lit(0.0)), F.lit(0.0)) \
        - F.when(around.rlike(rf"(?U)\b(?:{NOT_NEAR})\b"), F.lit(BONUS)).otherwise(F.lit(0.0))
    kind = by_rule(lambda r: F.lit(r.kind), F.lit(None).cast("string"))
    kind_no = by_rule(lambda r: F.lit(KINDS.index(r.kind)), F.lit(-1))
    placed = placed.select(
        "doc_id", "rid", F.when(by_rule(lambda r: F.expr(r.confirm), F.lit(False)), F.struct(
            (F.col("end") - F.char_length("m")).alias("start"), kind_no.alias("kind_no"), "end", kind.alias("kind"), F.round(score, 2).alias("score"),
            by_rule(lambda r: F.lit(r.base), F.lit(False)).alias("base"))).alias("s"))
    placed = placed.withColumn("s", F.when(F.col("s.base") | (F.col("s.score") >= least), F.col("s")))
    # the farthest end of a base match that begins here or before
    reach = F.max(F.when(F.col("s.base"), F.col("s.end"))).over(
        Window.partitionBy("rid").orderBy("s.start").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    kept = placed.withColumn("s", F.when(F.col("s.base") | (F.coalesce(reach, F.lit(0)) < F.col("s.end")), F.col("s")))
    best = kept.groupBy("rid", "doc_id", "s.start", "s.kind_no", "s.end", "s.kind").agg(F.max(F.struct("s.score", "s.base")).alias("b"))
    one = F.when(F.col("start").isNotNull(), F.struct("start", "kind_no", "end", "kind", "b.score", "b.base"))
    return best.groupBy("rid", "doc_id").agg(F.array_sort(F.collect_list(one)).alias("spans")).select("doc_id", "spans")


def listed(spans: F.Column) -> F.Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame, **how) -> DataFrame:
    base = F.filter("spans", lambda s: s["base"])
    count = [F.expr(f"size(filter(spans, s -> s.base and s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    return find(docs, **how).select("doc_id", *count, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def masked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """doc_id and the text with each span's characters outside of earlier spans replaced
    by ``<kind>``; rows are joined by id, so ids must be unique and not null."""
    spans = find(docs, doc_id, text, **how)
    parts = F.aggregate(
        "spans", F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(s["end"] <= a["at"], a).otherwise(F.struct(s["end"].alias("at"), F.concat(
            a["out"], F.substr(F.col("t"), (a["at"] + 1).cast("int"), F.greatest(s["start"] - a["at"], F.lit(0)).cast("int")), F.lit("<"), s["kind"], F.lit(">")).alias("out"))))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(spans, "doc_id")
    return rows.withColumn("p", parts).select("doc_id", F.concat("p.out", F.substr(F.col("t"), (F.col("p.at") + 1).cast("int"))).alias("text"))
