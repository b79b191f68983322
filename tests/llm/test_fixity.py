from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from headroom.llm import fixity


@pytest.fixture
def pages(spark):
    rows = [(i, f"http://a.example/{i}", f"<p>é {i}</p>\r\n\r\n" + "x" * (i % 7)) for i in range(75)]
    rows += [(3, "http://a.example/3", None), (3, "http://a.example/3", None), (None, "u", "no id"), (90, None, ""), (91, "u", "WARC/1.1")]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, record string, file int")


def test_files_give_back_every_record(spark, pages, tmp_path):
    records = fixity.archive(pages, per_file=30)
    fixity.write_files(records, str(tmp_path / "warc"))
    back = fixity.read_files(spark, str(tmp_path / "warc"))
    want = sorted((r.file, r.offset, r.record) for r in records.collect())
    assert sorted((r.file, r.offset, r.record) for r in back.collect()) == want and len(want) == 80
    audited = fixity.audit(records, back)
    assert audited.where("state != 'same' OR root != replica_root").count() == 0 and audited.count() == 80


def test_damage_is_found_where_it_is(spark, pages):
    records = fixity.archive(pages, per_file=30)
    lost, spoiled = [(0, 0), (2, 0)], [(1, 3), (2, 7)]
    place = F.struct("file", "number")
    replica = records.where(~place.isin([F.struct(F.lit(a).cast("long"), F.lit(b).cast("long")) for a, b in lost]))
    hit = place.isin([F.struct(F.lit(a).cast("long"), F.lit(b).cast("long")) for a, b in spoiled])
    replica = replica.withColumn("record", F.when(hit, F.concat("record", F.lit(" "))).otherwise(F.col("record")))
    audited = fixity.audit(records, replica.select("file", "offset", "record"))
    number = {(r.file, r.offset): r.number for r in records.collect()}
    found = {(r.file, number[r.file, r.offset]): r.state for r in audited.where("state != 'same'").collect()}
    assert found == {**{p: "gone" for p in lost}, **{p: "changed" for p in spoiled}}
    assert {r.file for r in audited.where("root = replica_root").collect()} == {f for f, _ in number} - {0, 1, 2}


def test_roots_by_hand(spark):
    pages = spark.createDataFrame([(i, "u", f"text {i}") for i in range(20)], "page_id long, url string, html string")
    records = fixity.archive(pages)
    rows = sorted(records.collect(), key=lambda r: r.number)

    def node(children):
        offset = children[0][0]
        text = f"{offset}:{sum(c[1] for c in children)}:" + ",".join(c[2] for c in children)
        return offset, sum(c[1] for c in children), hashlib.sha256(text.encode()).hexdigest()

    low = [(r.offset, r.length, hashlib.sha256(r.record.encode()).hexdigest()) for r in rows]
    assert [c[0] for c in low] == [sum(c[1] for c in low[:i]) for i in range(20)]
    root = node([node(low[:16]), node(low[16:])])[2]
    assert {r.root for r in fixity.audit(records, records).collect()} == {root}


def test_empty_tables(spark, pages):
    none = fixity.archive(pages.limit(0))
    assert fixity.audit(none, none).count() == 0
    some = fixity.archive(pages, per_file=30)
    assert {r.state for r in fixity.audit(some, none).collect()} == {"gone"}


@pytest.mark.parametrize("crowded_id", [5, None])
def test_an_id_with_very_many_rows_fills_several_files(spark, crowded_id):
    rows = [(crowded_id, "u", "the same page")] * 400 + [(i, "u", str(i)) for i in range(40)]
    records = fixity.archive(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), per_file=30)
    sizes = {r.file: r["count"] for r in records.groupBy("file").count().collect()}
    spread = {f: n for f, n in sizes.items() if f < -1}
    assert sum(spread.values()) == 400 + (crowded_id is not None) and len(spread) > 10 and max(spread.values()) < 90
    assert sorted(n for f, n in sizes.items() if f >= 0) == [10, 30 - (crowded_id is not None)]
    assert {r.state for r in fixity.audit(records, records).collect()} == {"same"}
