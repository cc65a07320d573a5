"""Open purchase orders (F3), settings documents (F6), channel files, scalar functions."""

import json

import pytest
from pyspark.sql import functions as F

from replenix import constants as K
from replenix.functions import scalar as S
from replenix.operators import purchase as PU
from replenix.operators import stock as ST
from replenix.operators.settings_ops import effective_settings, settings_document, sync_settings, upsert_setting
from replenix.sources import channel_files as CF
from replenix.sources.settings import parse_settings, read_settings, settings_from_text

from helpers import F1_FILES, write_channel


# ---------------------------------------------------------------- F3
@pytest.mark.parametrize("checkin,container,transit,production", [
    ("", "C1", 3, 0), ("NaT", "C1", 3, 0), (" null ", "C1", 3, 0), ("None", "C1", 3, 0),
    ("", "", 0, 3), ("", "nan", 0, 3), ("2026-07-02", "C1", 0, 0), ("2026-07-02", "", 0, 0)])
def test_f3_open_po(spark, checkin, container, transit, production):
    po = spark.createDataFrame([("918-1", K.NORTH, "3", checkin, container)],
                               "Sku string, Region string, QuantityOrdered string, CheckinDate string, ContainerNumber string")
    (r,) = PU.open_po(po).collect()
    assert (r.in_transit, r.in_production) == (transit, production)


def test_f3_no_container_column(spark):
    po = spark.createDataFrame([("918-1", K.NORTH, "3", None)], "Sku string, Region string, QuantityOrdered string, "
                               "CheckinDate string")
    (r,) = PU.open_po(po).collect()
    assert (r.in_transit, r.in_production) == (3, 0)


# ---------------------------------------------------------------- F6
DOC = {"_说明": "x", "default": {"LeadTime": 90, "LogisticsTime": 30, "备注": "d"},
       "channels": {"a": {"LeadTime": 120, "LogisticsTime": 45}, "b": {"LeadTime": "100"},
                    "c": {"LeadTime": "x", "LogisticsTime": None}, "e": {"LeadTime": 90.7},
                    "f": {"LeadTime": True}, "_note": {"LeadTime": 1}}}


def test_f6_settings_rules(spark):
    rows = {r.entry: (r.lead_time, r.logistics_time) for r in settings_from_text(spark, json.dumps(DOC)).collect()}
    assert rows == {None: (90, 30), "a": (120, 45), "b": (100, 30), "c": (90, 30), "e": (90, 30), "f": (1, 30)}


def test_f6_effective_and_source(spark):
    st = settings_from_text(spark, json.dumps(DOC))
    ch = spark.createDataFrame([("a",), ("zzz",)], "channel string")
    rows = {r.channel: r for r in effective_settings(ch, st).collect()}
    assert (rows["a"].lead_time, rows["a"].settings_source) == (120, "channels_settings.json")
    assert (rows["zzz"].lead_time, rows["zzz"].logistics_time, rows["zzz"].settings_source) == (90, 30, "default")
    ovr = spark.createDataFrame([("a", 10, 5)], "channel string, lead_time int, logistics_time int")
    rows = {r.channel: r for r in effective_settings(ch, st, ovr).collect()}
    assert (rows["a"].lead_time, rows["a"].logistics_time) == (10, 5)


def test_f6_legacy_root_default(spark):
    rows = settings_from_text(spark, json.dumps({"LeadTime": 70, "LogisticsTime": "20"})).collect()
    assert [(r.entry, r.lead_time, r.logistics_time) for r in rows] == [(None, 70, 20)]


def test_f6_read_file_and_fallback(spark, tmp_dir):
    assert read_settings(spark, tmp_dir).collect()[0].lead_time == K.DEFAULT_LEAD_TIME
    with open(f"{tmp_dir}/channels_settings.template.json", "w", encoding="utf-8") as fh:
        json.dump({"default": {"LeadTime": 60}, "channels": {"918": {"LogisticsTime": 10}}}, fh)
    rows = {r.entry: (r.lead_time, r.logistics_time) for r in read_settings(spark, tmp_dir).collect()}
    assert rows == {None: (60, 30), "918": (60, 10)}


def test_sync_and_upsert(spark):
    st = settings_from_text(spark, json.dumps(DOC))
    chans = spark.createDataFrame([("a",), ("new",)], "channel string")
    rows = {r.entry: (r.lead_time, r.note) for r in sync_settings(chans, st).collect()}
    assert rows == {None: (90, "d"), "a": (120, "d"), "new": (90, "d")}
    up = upsert_setting(st, spark.createDataFrame([("a", 1, 2, "n")], "entry string, lead_time int, "
                                                  "logistics_time int, note string"))
    assert {r.entry: r.lead_time for r in up.collect()}["a"] == 1
    doc = json.loads(settings_document(sync_settings(chans, st)).collect()[0].value)
    assert doc["channels"]["new"]["LeadTime"] == 90 and doc["default"]["LogisticsTime"] == 30


# ---------------------------------------------------------------- channel files
def test_channel_discovery_and_headers(spark, tmp_dir):
    write_channel(tmp_dir, "918", F1_FILES)
    write_channel(tmp_dir, "001", {"stock.csv": "Sku,PriceRadarVolume,IsDiscontinued,SouthIslandStock,NorthIslandStock,"
                                                "ImagePath\n001-7,0.5,true,1,2,imgs\\a b.jpg\n"})
    write_channel(tmp_dir, "_hidden", {"stock.csv": "Sku\nX\n"})
    write_channel(tmp_dir, ".git", {"stock.csv": "Sku\nX\n"})
    assert CF.list_channels(spark, tmp_dir) == ["001", "918"]
    stock = ST.stock_long(CF.read_stock(spark, tmp_dir))
    rows = {(r.channel, r.sku, r.region): r for r in stock.collect()}
    assert len(rows) == 6
    r = rows[("001", "001-7", K.SOUTH)]  # SKU text keeps its leading zeros
    assert r.is_discontinued == 1 and r.name == "" and r.image_url == K.IMAGE_BASE + "imgs/a%20b.jpg"
    files = CF.channel_files(spark, tmp_dir)
    from replenix.operators.quality import missing_files
    miss = {(r.channel, r.file) for r in missing_files(spark.createDataFrame([("001",), ("918",)], "channel string"),
                                                        files).collect()}
    assert ("001", "PO.csv") in miss and not any(c == "918" for c, _ in miss)


def test_first_row_per_key(spark, tmp_dir):
    write_channel(tmp_dir, "918", {"stock.csv": "Sku,PriceRadarVolume,IsDiscontinued,SouthIslandStock,NorthIslandStock\n"
                                                "A,0.1,0,1,1\nA,0.2,0,9,9\n"})
    (r,) = ST.stock_long(CF.read_stock(spark, tmp_dir)).filter(F.col("region") == K.SOUTH).collect()
    assert (r.on_hand, r.unit_volume) == (1.0, 0.1)


def test_first_row_without_an_order_is_the_least(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("a", None, "z"), ("b", 5, None), (None, 1, "n")], "k string, v int, t string")
    for n in (1, 3):
        assert sorted(map(str, ST.first_per(df.repartition(n), ["k"]).collect())) == sorted(map(str, [df.collect()[2], df.collect()[3], df.collect()[4]]))
    assert ST.first_per(df.select("k"), ["k"]).count() == 3


# ---------------------------------------------------------------- scalar functions
@pytest.mark.parametrize("path,url", [
    ("img\\a b/c #1.jpg", K.IMAGE_BASE + "img/a%20b/c%20#1.jpg"),
    ("/x/y%20z.png", K.IMAGE_BASE + "x/y%20z.png"),
    ("https://h.example/p q.jpg?x=1 2", "https://h.example/p%20q.jpg?x=1 2"),
    ("a~b*c+d:e.jpg", K.IMAGE_BASE + "a~b%2Ac%2Bd:e.jpg"),
    ("中文 图.jpg", K.IMAGE_BASE + "%E4%B8%AD%E6%96%87%20%E5%9B%BE.jpg"),
    ("  ", ""), (None, "")])
def test_image_url(spark, path, url):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(S.normalize_image_url("p")).collect()[0][0] == url


@pytest.mark.parametrize("text,value", [(" 3 ", 3.0), ("x", 0.0), ("NaN", 0.0), ("true", 1.0), (None, 0.0), ("-2.5", -2.5),
                                        ("12f", 0.0), ("inf", 0.0), ("\t7\u3000", 7.0), ("1e2", 100.0)])
def test_to_number(spark, text, value):
    assert spark.createDataFrame([(text,)], "t string").select(S.to_number("t")).collect()[0][0] == value


@pytest.mark.parametrize("text,ok", [('[{"WarehouseId":"x"}]', True), ("{}", True), ("[]", True), ("n/a", False),
                                     ("42", False), ('"s"', False), (None, False), ('[1] x', False), ('[1][2]', False),
                                     ('[1]] [', False), ('[1],2', False), ('[1', False), ("['a']", False), ("{'a':1}", False),
                                     ('﻿[1]', False), (' \r\n[1]\t', True), ('\x0c[1]', False), ('{"a":1}}', False),
                                     ('{"a":1,"a":2}', True), ('[1,]', False), ('[01]', False), ('[NaN]', False), ('["a\tb"]', False),
                                     ('["it\'s"]', True), (r'["\""]', True), (r'["a\"]', False), (r'["\x"]', False), ('{a:1}', False),
                                     ('["a" "b"]', False), ('/**/[1]', False), ('[1]//', False), ("", False), (" ", False),
                                     ('["' + "x" * 1_000_000 + '"]', True), ('["' + r"\n" * 300_000 + '"]', True), ("[" * 99 + "]" * 98, False)])
def test_is_json(spark, text, ok):
    assert spark.createDataFrame([(text,)], "t string").select(S.is_json("t")).collect()[0][0] is ok


def test_first_warehouse_of_whole_documents_only(spark):
    one = '[{"WarehouseId":"g"}]'
    texts = [one, one + " x", one + one, one[:-1], one.replace('"', "'"), '{"WarehouseId":"g"}', '[{"WarehouseId":"g","WarehouseId":"h"}]', "[]", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(S.json_first_warehouse("t")).collect()] == ["g", None, None, None, None, None, "g", None, None]


def test_try_guid(spark):
    df = spark.createDataFrame([(" AAAAAAAA-0000-4000-8000-000000000001 ",), ("nope",)], "t string")
    assert [r[0] for r in df.select(S.try_guid("t")).collect()] == ["aaaaaaaa-0000-4000-8000-000000000001", None]


def test_fmt_fixed_half_even(spark):
    df = spark.createDataFrame([(2.5, 0.125, -1.0)], "a double, b double, c double")
    r = df.select(S.fmt_fixed("a", 0), S.fmt_fixed("b", 2), S.fmt_fixed("c", 0, True)).collect()[0]
    assert tuple(r) == ("2", "0.12", "-")


def test_py_fixed_matches_python_on_ties(spark):
    vals = [(2 * n + 1) / 2 / 10 ** d for d in range(0, 6) for n in range(0, 400, 7)]
    vals += [2.675, 1.005, 0.0005, 5e-05, -0.0005, -0.0, 1234567.8915, 9.45, 0.1 * 90]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    for d in range(0, 6):
        got = [r[0] for r in df.select(S.py_fixed("x", d)).collect()]
        assert got == [format(v, f".{d}f") for v in vals], d


def test_f6_legacy_root_over_default_object(spark):
    doc = {"default": {"LeadTime": 80, "LogisticsTime": 25}, "LeadTime": 70}
    rows = settings_from_text(spark, json.dumps(doc)).collect()
    assert [(r.entry, r.lead_time, r.logistics_time) for r in rows] == [(None, 70, 25)]
    doc = {"default": {"LeadTime": 80}, "channels": {"a": {}}, "LeadTime": 70}
    rows = {r.entry: r.lead_time for r in settings_from_text(spark, json.dumps(doc)).collect()}
    assert rows == {None: 80, "a": 80}
