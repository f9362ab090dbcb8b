"""Archives, line dedup and mixing: SQL oracles and small edge cases."""

import gzip
import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from gridwright.llm import lines, media, mixing, near, quality, queries, secrets, skew, warc


def rows_of(frame_rows, columns):
    return sorted((tuple(r[c] for c in columns) for r in frame_rows), key=str)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, sf001, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf001}/{t}.parquet'")
    found = con.execute(queries.SQL[name])
    columns = sorted(d[0] for d in found.description)
    want = rows_of([dict(zip([d[0] for d in found.description], r, strict=True)) for r in found.fetchall()], columns)
    got = queries.QUERIES[name](spark, sf001)
    assert sorted(got.columns) == columns
    assert rows_of(got.collect(), columns) == want


@pytest.mark.parametrize("version", ["1", "2"])
def test_arc_records_are_read_by_declared_length(version):
    records = [("http://a.example/x y", "1.2.3.4", "20010203040506", "text/html", b"HTTP/1.0 200 OK\r\n\r\nbody\nhttp://fake 0 0 text/html 3\n"), ("http://b.example/", "0.0.0.0", "2001", "text/plain", b"")]
    data = warc.arc_file(records, version)
    found = list(warc.parse_arc(data))
    assert [(r["url"], r["ip"], r["date"], r["type"], r["body"]) for r in found] == records
    assert list(warc.parse_arc(data[:-1] + b"\nodd line\nmore\n"))[-1]["error"] == "bad header line, 14 bytes unread"
    with pytest.raises(ValueError):
        list(warc.parse_arc(b"nothing"))
    with pytest.raises(ValueError):
        list(warc.parse_arc(b"filedesc://x 0 0 text/plain 4\n9 0 \n"))
    assert warc._iso("20010203040506") == "2001-02-03T04:05:06Z" and warc._iso("2001") == "1970-01-01T00:00:00Z"


def test_warc_round_trip_of_edges(spark, tmp_path):
    big = "ä\r\n\r\nWARC/1.0\r\n" * 30
    rows = [(3, "u", big), (1, None, big), (1, None, big), (5, "u", "short"), (6, "u", "short"), (7, "u", None), (None, "u", "none"), (8, "u\n2", ""), (None, "u", big)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, http int").repartition(2)
    warc.write_arc(pages, str(tmp_path / "a"), F.when(F.col("page_id") > 4, "2").otherwise("1"), size=300)
    out = warc.convert(spark, str(tmp_path / "a"), str(tmp_path / "w"), size=300).collect()
    names = {r.record_id: r for r in out}
    assert len(names) == len(rows) and all(names[r.refers_to_record].page_id == r.refers_to for r in out if r.record_type == "revisit")
    assert len(out) == len(rows) and not any(r.error for r in out)
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = Counter((i, len((t or "").encode()), digest(t), "revisit" if t == big and i != 1 else "response", 1 if t == big and i != 1 else None) for i, _, t in rows)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out) == want
    # members stand alone, one to a record
    files = [f.read_bytes() for f in (tmp_path / "w").glob("*.gz")]
    assert len(files) > 2 and sum(m.startswith(b"WARC/1.0\r\nWARC-Type: re") for f in files for m in warc.members(f)) == len(rows)
    assert all(gzip.decompress(f) == b"".join(warc.members(f)) for f in files)
    warc.write_arc(pages.limit(0), str(tmp_path / "ea"))
    assert warc.convert(spark, str(tmp_path / "ea"), str(tmp_path / "ew")).count() == 0


def test_archives_keep_bytes_and_report_errors(spark, tmp_path):
    (tmp_path / "a").mkdir()
    raw = bytes(range(256)) * 3
    good = warc.arc_file([("http://a/", "0.0.0.0", "19990101000000", "image/png", raw), ("http://b/", "0.0.0.0", "19990101000001", "image/png", b"HTTP/1.0 200 OK\r\n\r\n" + raw)], "2")
    (tmp_path / "a" / "1.arc").write_bytes(good)
    (tmp_path / "a" / "2.arc").write_bytes(good[:-300])
    (tmp_path / "a" / "3.arc").write_bytes(b"no archive")
    out = warc.convert(spark, str(tmp_path / "a"), str(tmp_path / "w")).collect()
    digest = hashlib.sha256(raw).hexdigest()
    assert [r.payload_digest for r in out if not r.error] == [digest] * 3
    assert sorted(r.error for r in out if r.error) == ["no version block, 10 bytes unread", f"truncated record, {len(raw) + 19 - 299} of {len(raw) + 19} bytes there"]


def test_line_dedup_of_short_and_unspaced_lines(spark, tmp_path):
    wide = "".join(chr(0x4E00 + i) for i in range(500))
    rows = [(1, f"menu\n{wide}\nown"), (2, f"Menu \n\nother\n{wide}"), (3, "\n\nmenu")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_removed, r.kept_text) for r in queries.QUERIES["op8_line_dedup_all"](spark, str(tmp_path)).collect()}
    assert got == {1: (0, rows[0][1]), 2: (2, "\nother"), 3: (1, "\n")}


def test_line_dedup_of_edges(spark):
    a, b, short = "One two three four five", "one  two THREE four five ", "too short"
    rows = [(2, f"{b}\n{short}\nsix seven eight nine ten"), (1, f"{a}\n{short}"), (3, f"{a}\n{a}"), (4, None), (5, ""), (None, a), (6, f"x\n{a}"), (6, f"x\n{a}")]
    docs = spark.createDataFrame([(*r, 0, "z") for r in rows], "doc_id long, text string, pos int, row string")
    got = Counter((r.doc_id, r.n_removed, r.removed_offsets, r.kept_text) for r in lines.dedup_units(docs).collect())
    n = len(b)
    want = Counter([
        (2, 1, f"0:{n}", f"{short}\nsix seven eight nine ten"), (1, 0, "", f"{a}\n{short}"), (3, 2, f"0:{len(a)},{len(a) + 1}:{2 * len(a) + 1}", ""), (4, 0, "", None), (5, 0, "", ""),
        (None, 1, f"0:{len(a)}", ""), (6, 1, f"2:{2 + len(a)}", "x"), (6, 1, f"2:{2 + len(a)}", "x"),
    ])
    assert got == want
    paragraphs = spark.createDataFrame([(1, f"{a}\n\n{short}"), (2, f"{short}\n \n{a}\n\nend")], "doc_id long, text string")
    got = {r.doc_id: r.kept_text for r in lines.dedup_units(paragraphs, "paragraph").collect()}
    assert got == {1: f"{a}\n\n{short}", 2: f"{short}\n \nend"}
    assert lines.dedup_units(docs.limit(0)).count() == 0


def plain_passages(rows, words):
    """Passage dedup by regular expressions and dictionaries: (doc_id, n_units, n_removed, kept_text)."""
    ends = re.compile(r"^[ \t\r\n]+|[.!?][ \t\r\n]+|[。！？][ \t\r\n]*|[ \t\r]*\n[ \t\r\n]*")
    clean = lambda t: re.sub(r"[ \t\r\n]+", " ", t.lower()).strip(" ")
    found, parts = {}, {}
    for key in {r for r in rows if r[1] is not None}:
        cuts = [0, *(m.end() for m in ends.finditer(key[1])), len(key[1])]
        parts[key] = [key[1][a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        units = [i for i, u in enumerate(parts[key]) if clean(u)]
        size = [max(len(clean(parts[key][i]).split(" ")), len(clean(parts[key][i])) // lines.WIDE) for i in units]
        for i in range(len(units)):
            j = next((j for j in range(i, len(units)) if sum(size[i : j + 1]) >= words), None)
            if j is not None:
                found.setdefault(clean("".join(parts[key][units[i] : units[j] + 1])), []).append((key[0] is None, key[0] or 0, key[1], i, [*units[i : j + 1]], key))
    gone, kept = set(), set()
    for same in found.values():
        same.sort(key=lambda x: (x[0], x[1], hash_of[x[2]], x[3]))
        times = sum(rows.count(x[5]) for x in same)
        for n, x in enumerate(same):
            (kept if n == 0 else gone).update((x[5], k) for k in x[4] if times > 1)
    gone -= kept
    out = []
    for key in rows:
        if key[1] is None:
            out.append((key[0], 0, 0, None))
            continue
        left = [u for k, u in enumerate(parts[key]) if (key, k) not in gone]
        out.append((key[0], sum(bool(clean(u)) for u in parts[key]), len(parts[key]) - len(left), "".join(left)))
    return Counter(out)


hash_of: dict = {}


def test_passage_dedup_matches_plain_python(spark):
    r = random.Random(4)
    stock = ["Ein  Satz hier. ", "Zwei drei VIER!\n", "一二三四五六七八九十一二三四五六七八。", "Nur ein Wort?\t", "a\n", "kein Ende ", " . ", "\n\n", "ÄÖ é. "]
    rows = [(None if i % 9 == 0 else i // 2, "".join(r.choices(stock, k=r.choice([1, 3, 8, 30])))) for i in range(60)]
    rows += [(1, None), (2, ""), (3, " \n "), (5, "x"), (7, rows[7][1]), (7, rows[7][1]), (None, rows[9][1])]
    docs = spark.createDataFrame([(*x, 1, "r", True) for x in rows], "doc_id long, text string, pos int, row string, `first.one` boolean")
    hash_of.update({x.text: x.h for x in docs.selectExpr("text", "xxhash64(text) AS h").collect()})
    for words in (4, 9):
        got = lines.dedup_passages(docs, words).collect()
        assert Counter((x.doc_id, x.n_units, x.n_removed, x.kept_text) for x in got) == plain_passages(rows, words)
        for x in got:
            text = {(a, b): b for a, b in rows}
            spans = [tuple(map(int, s.split(":"))) for s in x.removed_offsets.split(",") if s]
            cut = lambda t, spans=spans: "".join(t[a:b] for a, b in zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), len(t)], strict=True))
            assert x.kept_text is None or any(k[0] == x.doc_id and t is not None and cut(t) == x.kept_text for k, t in text.items())
    assert lines.dedup_passages(docs.limit(0)).count() == 0


def test_hot_passages_are_joined_apart(spark, monkeypatch):
    text = "One two three four. Five six seven eight."
    docs = spark.createDataFrame([(i, f"{i} own words are here. {text}") for i in range(40)], "doc_id long, text string")
    cold = Counter(map(str, lines.dedup_passages(docs, 5).collect()))
    monkeypatch.setattr(skew, "HOT", 1)
    monkeypatch.setattr(skew, "HOT_SHARE", 1000)
    assert Counter(map(str, lines.dedup_passages(docs, 5).collect())) == cold
    assert sum(x.n_removed for x in lines.dedup_passages(docs, 5).collect()) == 78


def test_mixing_meets_target_weights(spark):
    rows = [(i, "x" * 100, "big" if i % 10 else "small") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    counts = Counter(r.source for r in mixing.mixed(docs, weights={"big": 1.0, "small": 1.0}).collect())
    assert abs(counts["big"] - 2000) < 180 and abs(counts["small"] - 2000) < 180
    rare = docs.where("doc_id < 40").withColumn("source", F.when(F.col("doc_id") == 0, "tiny").otherwise("big"))
    copies = mixing.mixed(rare, weights={"tiny": 1.0, "big": 1e-4}).groupBy("source").count().collect()
    assert [r["source"] for r in copies] == ["tiny"] and len(copies) == 1 and 10 < copies[0]["count"] < 75
    again = mixing.replicate(docs, weights={"big": 1.0, "small": 1.0}).groupBy("row.doc_id").count().collect()
    assert max(r["count"] for r in again if r.doc_id % 10 == 0) > 5
    only = mixing.mixed(docs, weights={"small": 1.0})
    assert {r.source for r in only.collect()} == {"small"}


def test_column_names_of_any_kind(spark):
    text = "token = \"9f86d081884c7d659a2feaa0c55ad015a3bf4f1b\""
    wide = spark.createDataFrame([(1, text, "s", 1, 2)], "doc_id long, text string, source string, `a.b` int, `c``.d` int")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    for out in (quality.kept_only(wide, labels, 0.0), near.deduped(wide), secrets.redacted(wide, secrets.Forest([], secrets.Pairs({})))):
        assert out.columns == wide.columns and out.count() == 1 and out.first()[3:] == (1, 2)
    # how often a row is drawn at a rate of 1 is a matter of its hash: 200 rows give about 200 copies
    many = spark.createDataFrame([(i, text, "s", 1, 2) for i in range(200)], wide.schema)
    mixed = mixing.mixed(many)
    assert mixed.columns == wide.columns and abs(mixed.count() - 200) < 60 and {tuple(r)[3:] for r in mixed.collect()} == {(1, 2)}
    kept = media.index_media(media.mux_texts(wide).withColumnRenamed("n_bytes", "n.bytes"))
    assert kept.columns == ["doc_id", "n.bytes", "media_index"] and kept.first()[2]["keyframes"]


def test_rates_of_millions_need_few_steps(spark):
    given = spark.createDataFrame([("a", 3e6), ("b", 200.0), ("c", 0.0), ("d", 2.5)], "source_key string, rate double")
    got = {r.source_key: (r.low, r.cdf) for r in mixing.cutoffs(given).collect()}
    assert len(got["a"][1]) < 50_000 and got["a"][0] > 2.9e6 and got["c"] == (0, [1.0] * 41)
    for key, rate in (("a", 3e6), ("b", 200.0), ("d", 2.5)):
        low, cdf = got[key]
        assert abs(cdf[-1] - 1) < 1e-9 and abs(low + sum(1 - c for c in cdf) - rate) < 1e-4 * rate**0.5
    exact = [sum(math.exp(-2.5 + i * math.log(2.5) - math.lgamma(i + 1)) for i in range(k + 1)) for k in range(40)]
    assert max(abs(a - b) for a, b in zip(got["d"][1], exact, strict=False)) < 1e-12


def test_mixing_of_edges(spark, monkeypatch):
    rows = [(1, None, "a"), (2, "", "a"), (None, "text " * 50, None), (3, "text " * 50, "b"), (3, "text " * 50, "b"), (4, "z" * 100_000, "c")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, source string, cdf double")
    one = mixing.mixed(docs)
    assert one.columns == docs.columns
    assert mixing.mixed(docs.limit(0)).count() == 0
    first = sorted(map(str, one.collect()))
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 0)
    assert sorted(map(str, mixing.mixed(docs).collect())) == first
