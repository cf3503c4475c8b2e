import gzip
import hashlib

from pyspark.sql import functions as F

from swathe.llm import warc


def plain(a, b, size=256):
    def place(rows):
        out, at = {}, {}
        for i, t in sorted(rows):
            f = i // size
            n = len((t or "").encode())
            out[i] = (f, at.get(f, 0), n, hashlib.sha256((t or "").encode()).hexdigest())
            at[f] = at.get(f, 0) + n
        return out

    x, y = place(a), place(b)
    rows = []
    for i in sorted({*x, *y}):
        status = "missing" if i not in y else "extra" if i not in x else "ok" if x[i][3] == y[i][3] else "corrupt"
        f, at, n, h = x.get(i, y.get(i))
        rows.append((i, f, at, n, h if i in x else None, y[i][3] if i in y else None, status))
    return rows


def test_against_plain_python(spark):
    a = [(k * 37 % 1009 - 40, f"record {k} é" * (k % 5)) for k in range(700)] + [(10**12, "far"), (-(10**12), "low")]
    b = [(i, t + "!" if i % 97 == 5 else t) for i, t in a if i % 89 != 3] + [(5000, "new"), (-900, "new")]
    make = lambda rows: spark.createDataFrame([(*r, "x") for r in rows], "page_id long, record string, status string").repartition(3)
    got = sorted(tuple(r) for r in warc.audit(make(a), make(b)).collect())
    assert got == plain(a, b)
    assert warc.audit(make(a), make(a)).where("status <> 'ok'").count() == 0
    assert warc.audit(make([]), make([])).count() == 0
    assert {r["status"] for r in warc.audit(make(a[:5]), make([])).collect()} == {"missing"}


def test_repeated_and_null_ids(spark):
    schema = "page_id long, record string"
    a = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (None, "n"), (2, None)], schema)
    b = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (None, "n"), (2, "")], schema)
    got = {r["page_id"]: r["status"] for r in warc.audit(a, b).collect()}
    assert got[1] == "corrupt" and got[None] == "ok"
    assert warc.audit(a, a.orderBy(F.rand(3))).where("status <> 'ok'").count() == 0


def test_records_are_parsed_back(spark):
    pages = spark.createDataFrame([(1, "http://a", "<p>é</p>"), (2, None, None)], "page_id long, url string, html string")
    texts = [r[0] for r in pages.orderBy("page_id").select(warc.record(F.col("page_id"), F.col("url"), F.col("html"))).collect()]
    data = "".join(texts).encode()
    files = spark.createDataFrame([("f", data), ("cut", data[:-9]), ("none", None), ("junk", b"junk")], "path string, content binary")
    rows = warc.parse_records(files).collect()
    own = [r for r in rows if r["path"] == "f"]
    assert [bytes(r["body"]).decode() for r in own] == ["<p>é</p>", ""] and own[0]["uri"] == "http://a" and own[0]["kind"] == "response"
    assert [r["first_byte"] for r in own] == [0, len(texts[0].encode())]
    assert {r["path"] for r in rows if r["error"]} == {"cut", "junk"}


def test_members_are_parsed_back(spark):
    def text(uri, body):
        return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: {uri}\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n".encode()

    parts = [gzip.compress(text("a", "x" * 200_000)), gzip.compress(text("b", "y") + text("c", "")), gzip.compress(text("d", "z"))]
    files = spark.createDataFrame([("f", b"".join(parts)), ("cut", b"".join(parts)[:-3]), ("junk", parts[0] + b"junk")], "path string, content binary")
    rows = warc.parse_records(files).collect()
    own = [r for r in rows if r["path"] == "f"]
    assert [(r["uri"], len(r["body"]), r["first_byte"], r["n_bytes"]) for r in own] == [
        ("a", 200_000, 0, len(parts[0])), ("b", 1, len(parts[0]), len(parts[1])), ("c", 0, len(parts[0]), len(parts[1])), ("d", 1, len(parts[0]) + len(parts[1]), len(parts[2])),
    ]
    assert [r["uri"] for r in rows if r["path"] == "cut"] == ["a", "b", "c", None] and [r["uri"] for r in rows if r["path"] == "junk"] == ["a", None]


def test_levels_shrink_however_far_apart_ids_lie(spark):
    ids = spark.createDataFrame([((k * 2654435761 << 20) % (1 << 63) - (1 << 62),) for k in range(300)] + [(None,)], "id long").repartition(4)
    place = warc.slots(ids.unionAll(ids)).collect()
    assert sorted(r["slot"] for r in place) == list(range(301)) and [r["id"] for r in sorted(place, key=lambda r: r["slot"])][:1] == [None]
    assert [r["id"] for r in sorted(place, key=lambda r: r["slot"])][1:] == sorted(r["id"] for r in place if r["id"] is not None)
    leaf = spark.createDataFrame(place).selectExpr("slot", "1L AS n_bytes", "sha2(string(slot), 256) AS sha256")
    assert [t.count() for t in warc.tree(leaf, 301)] == [301, 19, 2, 1]
