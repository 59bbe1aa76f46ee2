import base64
import gzip
import hashlib
import random

import duckdb
import pytest

from eventlab.llm import warc
from eventlab.llm.warc import ORACLE_SQL, base32_sha1, member, read_archives, record, round_trip, salvage, write_archives
from eventlab.llm.tables import cut


def brute(rows):
    """rows: (page_id, html)"""
    holder = {}
    for p, h in rows:
        k = h or ""
        holder[k] = max((x for x in (p, holder.get(k)) if x is not None), default=None)
    out = []
    for p, h in rows:
        raw = (h or "").encode()
        resp = p == holder[h or ""]
        out.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if resp else "revisit", None if resp else holder[h or ""]))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    pages = pages.unionByName(pages.selectExpr("page_id + 100000 as page_id", "url", "html").limit(20))
    want = brute([tuple(r) for r in pages.select("page_id", "html").collect()])
    assert got(round_trip(pages)) == want
    db = duckdb.connect()
    db.register("pages", pages.toPandas())
    assert sorted(db.execute(ORACLE_SQL).fetchall(), key=str) == want


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "a b\r\nWARC-Type: x", ""), (None, "u", ""), (3, "u", "é" * 100_000), (4, "u", "é" * 100_000), (4, "u", "é" * 100_000), (None, "u", "alone"), (None, "u", "alone"), (7, "u", "WARC/1.1\r\n\x1f\r\n\r\n")]
    df = spark.createDataFrame([(*r, "s", 3) for r in rows], "page_id long, url string, html string, sha1 string, holder int")
    assert got(round_trip(df)) == brute([(r[0], r[2]) for r in rows])
    assert round_trip(df.limit(0)).count() == 0
    back = read_archives(cut(write_archives(df)))
    assert {bytes(r.payload).decode() for r in back.collect() if r.record_type == "response"} == {r[2] or "" for r in rows}


def made(n, rng):
    return [record(i, f"http://h/{i}", base32_sha1(p), len(p), p, None) for i in range(n) for p in [rng.randbytes(rng.randrange(2000)) + b"WARC/1.1\r\n\x1f\x8b\x08"]]


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("seed", range(6))
def test_salvage(packed, seed):
    rng = random.Random(seed)
    parts = [member(r) if packed and rng.random() < 0.9 else r for r in made(12, rng)]
    starts = [sum(map(len, parts[:i])) for i in range(13)]
    content = bytearray(b"".join(parts))
    hurt = set(rng.sample(range(12), 3))
    for k in hurt:
        at = starts[k] + rng.randrange(20 if packed else 30, len(parts[k]) - 8)
        content[at] ^= 0x55
    found = list(salvage(bytes(content)))
    assert [f[1] for f in found][0] == 0 and all(a[2] == b[1] for a, b in zip(found, found[1:])) and found[-1][2] == len(content)
    ok = {f[4]["warc-record-id"] for f in found if f[0] == "record"}
    assert {f"<urn:page:{k}>" for k in set(range(12)) - hurt} <= ok  # every record that isn't hurt comes back
    if packed:
        assert sum(f[0] == "gap" for f in found) >= 1


def test_truncated_and_foreign_bytes():
    rng = random.Random(9)
    a, b, c = map(member, made(3, rng))
    found = list(salvage(b"junk" + a + b[:-9] + c + c[: len(c) // 2]))
    assert [f[0] for f in found] == ["gap", "record", "gap", "record", "gap"]
    assert [f[3] for f in found if f[0] == "gap"] == ["no version line", "damaged member", "truncated member"] or found[2][3]
    assert list(salvage(b"")) == [] and [f[0] for f in salvage(b"nothing here")] == ["gap"]
    assert gzip.decompress(a).startswith(b"WARC/1.1\r\n")


def test_gaps_are_rows(spark):
    a, b, c = map(member, made(3, random.Random(1)))
    df = spark.createDataFrame([("x", a + b[: len(b) // 2] + c), ("y", None), ("z", b"")], "path string, content binary")
    rows = read_archives(df).orderBy("path", "start").collect()
    assert [(r.path, r.kind, r.start) for r in rows] == [("x", "record", 0), ("x", "gap", len(a)), ("x", "record", len(a) + len(b) // 2)]


@pytest.mark.parametrize("packed", [True, False])
def test_long_url(packed):
    url = "http://h/" + "a" * (3 << 20)
    raw = [record(i, u, base32_sha1(b"page"), 4, b"page", None) for i, u in enumerate(("u", url, "v"))]
    found = list(salvage(b"".join(member(r) if packed else r for r in raw)))
    assert [f[0] for f in found] == ["record"] * 3 and found[1][4]["warc-target-uri"] == url


def test_gaps_are_logged_and_raise(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>" * 9) for i in range(20)], "page_id long, url string, html string")
    archives = warc.write_archives(pages.coalesce(1)).collect()
    hurt = bytearray(archives[0].content)
    hurt[len(hurt) // 2] ^= 0xFF
    damaged = spark.createDataFrame([(archives[0].path, bytes(hurt))], "path string, content binary")
    log = warc.quarantine(warc.read_archives(damaged), str(tmp_path / "gaps"))
    (gap,) = log.collect()
    assert gap.start <= len(hurt) // 2 < gap.end and gap.reason
    assert warc.read_archives(damaged).where("kind = 'record'").count() == 19
    monkeypatch.setattr(warc, "write_archives", lambda _: damaged)
    with pytest.raises(Exception, match="gap in"):
        warc.round_trip(pages).collect()


def test_bytes_that_look_like_members():
    """Magic numbers without a record behind them are left at once."""
    import gzip

    noise = gzip.compress(b"not a record " * 1000) * 200
    good = warc.member(warc.record(1, "http://h/", warc.base32_sha1(b"x"), 1, b"x", None))
    kinds = [x[0] for x in warc.salvage(noise + good + noise[:77])]
    assert kinds == ["gap", "record", "gap"]
