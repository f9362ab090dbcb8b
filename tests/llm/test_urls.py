"""The URL filter against a plain loop over rules, by both ways, with digests that collide."""

import duckdb
import numpy as np
import pytest

from gridwright.llm import skew, urls
from gridwright.sources.files import write_files


def plain(url, rules):
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = rest[:cut].translate(str.maketrans(urls.UPPER, urls.LOWER))
    tail = rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    best = None
    for rule, verdict in rules:
        h, slash, p = (rule or "").partition("/")
        h = h.translate(str.maketrans(urls.UPPER, urls.LOWER))
        if rule is not None and (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            best = max(best or (-1,), (len(h + slash + p), len(h), verdict == "block", h + slash + p))
    return host, path, best and best[3], "block" if best and best[2] else "allow"


RULES = [*urls.RULES, ("Example.ORG", "block"), ("b.c/xyz", "block"), ("a.b.c/x", "allow"), ("net/", "block"), ("twice.com/", "allow"), ("twice.com/", "block"), (None, "block"), ("ünï.de/é", "block"), ("c:8080/", "block")]
URLS = [
    "http://foo.net/", "http://foo.net", "http://foo.net?q=/", "HTTP://Foo.NET/a#b/c?d", "http://www.example.net/en/1", "http://example.net/EN/", "http://myexample.net/en/", "x://example.com/de/", "x://a.example.com/dex", None, "", "no scheme",
    "http://org/fr/", "http://a.org/fr/x?y://z", "http://EXAMPLE.org", "http://a.b.c/xyz", "http://twice.com/", "http://ünï.de/éa", "http://ÜNÏ.de/é", "http://c:8080/", "http://c/", "http://a.b.c://d/", "://net/", "http://.net/", "http://" + "a." * 3000 + "net/" + "x" * 100_000, "http://foo.net/\n/x",
]


@pytest.fixture()
def rows(spark):
    return spark.createDataFrame([(i, u, "own") for i, u in enumerate([*URLS, *URLS[:3]])] + [(None, URLS[0], "own"), (None, URLS[0], "own")], "page_id long, url string, host string")


def test_both_ways_equal_a_loop(spark, rows, monkeypatch):
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    want = sorted(((r.page_id, *plain(r.url, RULES)) for r in rows.collect()), key=str)
    assert sorted(map(tuple, urls.judged(rows, rules).collect()), key=str) == want
    monkeypatch.setattr(urls, "SHARD_BYTES", 64)  # an array of many files
    assert sorted(map(tuple, urls.judged(rows, rules).collect()), key=str) == want
    monkeypatch.setattr(urls, "MAP_BYTES", 0)
    assert sorted(map(tuple, urls.judged(rows, rules).collect()), key=str) == want
    monkeypatch.setattr(skew, "HOT", 1)
    monkeypatch.setattr(skew, "HOT_SHARE", 1000)
    assert sorted(map(tuple, urls.judged(rows, rules).collect()), key=str) == want


def test_equal_digests_are_told_apart(tmp_path, monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([-5, 7, 7, 7, 9]), pa.array(["z", "a", "b", "ä", "y"]), pa.array([True, True, False, True, False])], ["digest", "rule", "block"])
    ((first, body),) = urls._packed(iter([batch]))
    (tmp_path / "one").write_bytes(body)
    monkeypatch.setattr(urls.SparkFiles, "get", lambda name: str(tmp_path / name))
    array = urls.DigestArray([(first, "one")])
    part, place = array.probe(np.array([7, 8, -6, 9, -5]))
    assert part.tolist() == [0, -1, -1, 0, 0] and place[[0, 3, 4]].tolist() == [1, 4, 0]
    assert [array.confirmed(0, 1, x.encode()) for x in ("a", "b", "ä", "c", "y")] == [True, False, True, None, None]


def test_empty_lists_and_tables(spark, rows):
    none = spark.createDataFrame([], "rule string, verdict string")
    assert {(r.rule, r.verdict) for r in urls.judged(rows, none).collect()} == {(None, "allow")}
    assert urls.judged(rows.limit(0), spark.createDataFrame(RULES, "rule string, verdict string")).collect() == []


def test_query_equals_its_sql(spark, sf01):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf01}/pages.parquet/*.parquet'" if __import__("os").path.isdir(f"{sf01}/pages.parquet") else f"CREATE VIEW pages AS SELECT * FROM '{sf01}/pages.parquet'")
    got = [tuple(r) for r in urls.op11_url_filter(spark, sf01).collect()]
    assert sorted(got, key=str) == sorted(con.execute(urls.OP11_SQL).fetchall(), key=str)
    assert {r[4] for r in got} == {"allow", "block"} and len({r[3] for r in got}) > 3


def test_files_appear_together_or_not_at_all(spark, tmp_path):
    from pyspark.sql import functions as F

    at = f"file://{tmp_path}/out"
    write_files(spark.range(5).select(F.concat(F.lit("d/"), "id", F.lit(".gz")).alias("name"), F.encode(F.repeat(F.lit("x"), F.col("id").cast("int")), "UTF-8").alias("body")), at)
    assert sorted((p.name, p.read_bytes()) for p in (tmp_path / "out/d").iterdir()) == [(f"{i}.gz", b"x" * i) for i in range(5)]
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["_SUCCESS", "d"]
    broken = spark.range(4).select(F.col("id").cast("string").alias("name"), F.when(F.col("id") == 3, F.raise_error(F.lit("no"))).otherwise("a").cast("binary").alias("body"))
    with pytest.raises(Exception, match="no"):
        write_files(broken, f"file://{tmp_path}/bad")
    assert not (tmp_path / "bad").exists() or not list((tmp_path / "bad").iterdir())
