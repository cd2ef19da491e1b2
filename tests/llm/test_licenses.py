"""Licence scans against a plain Python canonical form."""

import hashlib
import re
import textwrap
from pathlib import Path

import pytest

from tilespark.llm import licenses, queries

SCHEMA = "doc_id long, text string, digest string, license int"


TALK = {"and", "disclaimer", "holder", "holders", "in", "interest", "interests", "law", "laws", "license", "licence", "licenses", "licences", "notice", "notices", "or", "owner", "owners", "permission", "protection", "statement", "statements", "treaty"}
OWNERS = re.compile(r"\b(?:19|20)[0-9]{2}\b|\(c\)|©|<year>|\[yyyy\]|\[year\]|\{yyyy\}|\{year\}|\b(?:authors?|by|contributors?|corporation|foundation|inc|ltd)\b", re.A)


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def copyright_line(line):
    """Of a line in lower case."""
    x = line.lstrip(" \t*#/;%!-")
    if x.startswith("©") or re.fullmatch(r"all rights reserved[ \t.]*", x):
        return True
    if x.startswith("(c)"):
        return bool(re.search(r"\b(?:19|20)[0-9]{2}\b", x[3:], re.A))
    m = re.match(r"(?:portions )?copyright\b", x, re.A)
    if not m:
        return False
    rest = x[m.end() :]
    word = re.match(r"[ \t]+([a-z]+)\b", rest, re.A)
    return not (word and word[1] in TALK) and bool(OWNERS.search(rest))


def canonical(text):
    x = "\n".join("" if copyright_line(line) else line for line in low(text).split("\n"))
    x = " ".join("".join(c if c.isalpha() or c.isnumeric() else " " for c in x).split(" "))
    x = re.sub(" +", " ", x).strip(" ")
    for a, b in licenses.SPELLINGS:
        x = re.sub(rf"\b{a}\b", b, x, flags=re.A)
    return x


def digest(text):
    return hashlib.sha256(canonical(text).encode()).hexdigest() if canonical(text) else None


def brute(text):
    """What the whole text is, and the notices in its lines, by comparing canonical texts."""
    whole = {canonical(f"{title}\n{t}"): k for k, v in licenses.LICENCES.items() for t in (v, v.replace("http://", "https://")) for title in ("", *licenses.TITLES[k])}
    known = {canonical(p.format(n)): k for k, names in licenses.NAMES.items() for n in (*names, k) for p in licenses.PHRASES}
    return whole.get(canonical(text)), sorted({known[c] for c in map(canonical, (text or "").split("\n")) if c in known})


def test_scan(spark, tmp_path):
    mit = licenses.LICENCES["MIT"]
    texts = {
        1: mit,
        2: "The MIT License\n\n" + mit,
        3: "MIT LICENSE\n\nCopyright (c) 2020 A. Person\n© 2021 B\n\n" + mit.replace("\n", "\n\n").replace(" ", "  ").upper(),
        4: mit.replace("sublicense", "sub-licence").replace('"', "“"),
        5: mit + " And more.",
        6: None,
        7: "",
        8: " \n..\n",
        9: "Prose.\nReleased under the MIT Licence.\nmore\n  licensed under the apache license version 2.0\nSPDX-License-Identifier: MIT",
        10: "This line is about the MIT License.",
        11: licenses.LICENCES["0BSD"],
        12: licenses.LICENCES["BSD-3-Clause"].replace("copyright holder", "copyright owner"),
        13: "x " * 60_000,
    }
    spark.createDataFrame([(i, t, "clash", 1) for i, t in texts.items()] + [(1, mit, "clash", 1)], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op7_licenses(spark, str(tmp_path)).collect()
    assert len(rows) == len(texts) + 1
    got = {r.doc_id: r for r in rows}
    want = dict.fromkeys(texts) | {1: "MIT", 2: "MIT", 3: "MIT", 4: "MIT", 11: "0BSD", 12: "BSD-3-Clause"}
    assert {i: r.license for i, r in got.items()} == want
    assert got[9].notices == "Apache-2.0,MIT" and got[10].notices == ""
    for i, t in texts.items():
        assert got[i].digest == digest(t), i
    assert licenses.scan_licenses(spark.createDataFrame([], SCHEMA)).collect() == []


def test_table(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op7_licenses(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.digest == digest(docs[r.doc_id])
        assert (r.license, r.notices) == (brute(docs[r.doc_id])[0], ",".join(brute(docs[r.doc_id])[1]))
        if "Released under the MIT License." in (docs[r.doc_id] or "").split("\n"):
            assert "MIT" in r.notices.split(",")


def test_every_notice(spark):
    lines = [(k, p.format(n)) for k, names in licenses.NAMES.items() for n in (*names, k) for p in licenses.PHRASES]
    df = spark.createDataFrame(lines, "want string, text string")
    missed = [r.text for r in licenses.scan_licenses(df).collect() if list(r.notices) != [r.want]]
    assert missed == []


def test_long_texts(spark):
    folder = Path("/usr/share/common-licenses")
    files = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    if not all((folder / f).exists() for f in files.values()):
        pytest.skip("no licence texts here")
    rows = [(k, (folder / f).read_text()) for k, f in files.items()] + [("Apache-2.0", (folder / "Apache-2.0").read_text().split("   APPENDIX:")[0])]
    df = spark.createDataFrame(rows, "want string, text string")
    assert [r.want for r in licenses.scan_licenses(df).collect() if r.license != r.want] == []


def test_usual_layouts(spark):
    """Titles, copyright lines, comment signs and line breaks as files have them."""
    rows = []
    for k, text in licenses.LICENCES.items():
        for title in ("", *licenses.TITLES[k]):
            rows.append((k, f"{title}\n\nCopyright (c) 2020, A. Person <a@b.example>\nAll rights reserved.\n\n{text}"))
        for width in (40, 60, 72, 80):
            filled = "\n\n".join(textwrap.fill(part, width) for part in text.split("\n"))
            rows.append((k, f"{licenses.TITLES[k][0]}\n\nCopyright 1999-2004 B Foundation\n(c) 2001 C\n{filled}"))
            rows.append((k, "".join(f" * {line}\n" for line in f"Portions Copyright [yyyy] [name]\n{filled}".split("\n"))))
    df = spark.createDataFrame(rows, "want string, text string")
    assert [r.text[:60] for r in licenses.scan_licenses(df).collect() if r.license != r.want] == []


def test_more_texts_and_clashing_names(spark):
    more = spark.createDataFrame([("Own-1.0", "You may do as you like."), ("Own-2.0", "you MAY do: as you like"), (None, "x"), ("y", None)], "license string, text string")
    df = spark.createDataFrame([("Copyright 2020 X\nYou may do as you like!", "a", "b")] * 2 + [(None, "a", "b")], "text string, whole string, notices string")
    got = licenses.scan_licenses(df, more=more)
    assert sorted(got.columns) == ["digest", "license", "notices", "text", "whole"]
    assert sorted((r.license or "", r.whole) for r in got.collect()) == [("", "a"), ("Own-1.0", "a"), ("Own-1.0", "a")]


def test_unlicense(spark):
    text = licenses.LICENCES["Unlicense"]
    df = spark.createDataFrame([(t,) for t in (text, "The Unlicense\n\n" + text, text.replace("http:", "https:"))], "text string")
    assert [r.license for r in licenses.scan_licenses(df).collect()] == ["Unlicense"] * 3
