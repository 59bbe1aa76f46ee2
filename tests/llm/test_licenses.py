import duckdb
from pyspark.sql import functions as F

from eventlab.llm.licenses import ORACLE_SQL, TEMPLATES, document_path, scan_licenses

PROSE = "several more words that have nothing to do with any of these notices"


def got(df):
    return sorted(((r.doc_id, r.path, r.license, r.how, None if r.similarity is None else round(r.similarity, 4), r.inherited_from) for r in df.collect()), key=str)


def test_documents(spark, sf_dir):
    sf_dir = sf_dir.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    have = got(scan_licenses(docs, document_path()))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    cols = "doc_id, path, license, how, round(similarity, 4), inherited_from"
    assert have == sorted(db.execute(f"SELECT {cols} FROM ({ORACLE_SQL})").fetchall(), key=str)
    assert len({h[3] for h in have}) >= 3 and {h[2] for h in have} >= {"MIT", "GPL-3.0", "Apache-2.0", "CC-BY-NC-4.0"}


def test_directories(spark):
    rows = [
        (1, "Released under the MIT License.", "a/LICENSE"), (2, "plain text of a file", "a/b/c/x.txt"), (3, "LICENSED under the Apache license, version 2.0", "a/b/LICENSE"),
        (4, f"{PROSE}\nThis work is licensed under the GNU General Public License, version 3.\n{PROSE}", "a/b/y.txt"), (5, "none here", "ab/z.txt"), (6, None, None),
        (7, "", "a/b2/q"), (8, "of the in this", "top.txt"), (None, "some", "a/b/d/e"), (2, "plain text of a file", "a/b/c/x.txt"), (9, "x" * 100_000, "/abs/f"), (10, "Released under the MIT License", "/LICENSE"),
        (11, "the this is a under\nlicense", "zz/t"), (12, "\n".join(t for _, t in TEMPLATES if len(t) < 120), "zz/u"),
    ]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, p string, license string, held int")
    out = {(r[0], r[1]): r[2:] for r in got(scan_licenses(df, F.col("p")))}
    assert out[1, "a/LICENSE"][:2] == ("MIT", "file") and out[3, "a/b/LICENSE"][:2] == ("Apache-2.0", "file")
    assert out[2, "a/b/c/x.txt"][:2] == ("Apache-2.0", "inherited") and out[2, "a/b/c/x.txt"][3] == "a/b"
    assert out[4, "a/b/y.txt"][:2] == ("GPL-3.0", "header") and out[7, "a/b2/q"] == ("MIT", "inherited", None, "a")
    assert out[5, "ab/z.txt"][1] == "none" and out[6, None][1] == "none" and out[8, "top.txt"][1] == "none"
    assert out[None, "a/b/d/e"][3] == "a/b" and out[9, "/abs/f"] == ("MIT", "inherited", None, "") and out[11, "zz/t"][1] == "none"
    assert out[12, "zz/u"][1] == "header"
    assert len(got(scan_licenses(df, F.col("p")))) == len(rows)
    assert got(scan_licenses(df.limit(0), F.col("p"))) == []


def test_headers_files_and_size(spark):
    """Blocks over several lines, whole licences with names and years, notices among more words, and the same verdict among many more texts."""
    mit = [t for n, t in TEMPLATES if n == "MIT"][-1].replace("Copyright (c)", "Copyright (c) 2021 Some Name <some@example.org>")
    apache = [t for n, t in TEMPLATES if n == "Apache-2.0"][2]
    words = apache.split()
    header = "\n".join("# " + " ".join(words[i : i + 9]) for i in range(0, len(words), 9))
    gpl = "\n".join(" * " + x for x in [t for n, t in TEMPLATES if n == "GPL-3.0"][2].replace(" as ", "\n").split("\n"))
    code = " ".join(f"name{i} value{i % 7}" for i in range(300))
    rows = [
        (1, mit, "m/LICENSE"), (2, "code of m", "m/src/deep/er/x.py"), (3, f"import os\n\n{header}\n\ncode follows here\n" + code, "n/x.py"), (4, f"/*\n{gpl}\n *\n */\nint main;\n{code}", "n/y.c"),
        (5, f"// SPDX-License-Identifier: MIT\n{code}", "n/z.c"), (6, "Licensed under the Apache License, Version 2.0, by Acme", "n/w"), (7, f"{PROSE} license of the free software {PROSE}", "k/v"),
    ]
    few = [(100 + i, f"{PROSE} and to the of in {i}", f"q/{i}") for i in range(40)]
    many = [(1000 + i, f"{PROSE} and to the of in {i}", f"q/{i}") for i in range(4000)]
    for more in (few, many):
        df = spark.createDataFrame(rows + more, "doc_id long, text string, p string")
        out = {r[0]: r[2:] for r in got(scan_licenses(df, F.col("p")))}
        assert out[1][:2] == ("MIT", "file") and out[2] == ("MIT", "inherited", None, "m")
        assert out[3][:2] == ("Apache-2.0", "header") and out[4][:2] == ("GPL-3.0", "header") and out[5][:2] == ("MIT", "header")
        assert out[6][0] == "Apache-2.0" and out[7][1] == "none"


def test_given_templates(spark):
    t = spark.createDataFrame([("Own-1", "You may do with the frobnicator as you like")], "license string, text string")
    df = spark.createDataFrame([(1, "You may do with the frobnicator as you like!", "a/b"), (2, "Released under the MIT License", "c/d")], "doc_id long, text string, p string")
    assert [r[2] for r in got(scan_licenses(df, F.col("p"), t))] == ["Own-1", None]
    assert [r[2] for r in got(scan_licenses(df, F.col("p"), t.limit(0)))] == [None, None]
