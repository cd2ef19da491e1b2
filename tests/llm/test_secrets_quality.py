"""Secret scans and quality rules against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilespark.llm import quality, queries, secrets

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_words", T.IntegerType()), T.StructField("rule", T.IntegerType())])

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 16]
    return sorted(out)


def check_spans(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        want = base_spans(texts[r.doc_id])
        kinds = Counter(k for _, k, _ in want)
        joined = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert (r.n_assign, r.n_access, r.n_hex) == (kinds[0], kinds[1], kinds[2]), texts[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        got = [x for x in r.spans.split(",") if x]
        assert [x for x in got if not x.startswith("random:")] == [x for x in joined.split(",") if x]
        starts = [int(x.split(":")[1]) for x in got]
        assert starts == sorted(starts)


def random_texts():
    rnd = random.Random(1)
    hexes, b64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    parts = ["password", "PASSWD", "Secret", "token", "api_key", "APIKEY", "\"", "'", " ", "  ", ":", "=", "é", "\U0001f600", "\n", "AKIA", "AKIAAKIA"]
    out = {0: None, 1: "", 2: "password: token:abcdefghijkl1234", 3: "token=secret=abcdefghijklmnop", 4: "AKIA" + "Z" * 13, 5: "AKIA" + "Z" * 14, 6: "a" * 15, 7: "a" * 16, 8: "f" * 40_000 + " " + "x" * 40_000, 9: "paſſword=abcdefghijklmn"}
    for i in range(10, 500):
        t = []
        for _ in range(rnd.randint(0, 12)):
            t.append(rnd.choice(parts) if rnd.random() < 0.75 else "".join(rnd.choice(rnd.choice([hexes, b64, "AZ09"])) for _ in range(rnd.randint(8, 30))))
        out[i] = "".join(t)
    return out


def test_base_spans(spark, tmp_path):
    texts = random_texts()
    spark.createDataFrame([(i, t, "clash", 1, 1) for i, t in texts.items()], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    check_spans(queries.op6_secrets(spark, str(tmp_path)).collect(), texts)


def test_table_spans(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    check_spans(queries.op6_secrets(spark, sf_dir).collect(), texts)


def test_battery_tells_random_strings_from_text(spark):
    rnd = random.Random(7)
    alphabets = ["0123456789abcdef", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"]
    good, bad = [], []
    for i in range(400):
        a = alphabets[i % 4]
        good.append("".join(rnd.choice(a) for _ in range(rnd.choice([32, 40, 64, 100]))))
        bad.append(rnd.choice(["TheRiver", "someWords", "userAccount", "section", "Item"]) * rnd.randint(4, 8) + str(rnd.randint(1, 99)))
    rows = [(i, "see " + t + " there", "", 1, 1) for i, t in enumerate(good + bad)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = {r.doc_id for r in secrets.find_secrets(df).where("size(spans) > 0").collect()}
    assert sum(i in found for i in range(400)) >= 360
    assert sum(i in found for i in range(400, 800)) <= 4


def test_p_values_are_even_under_randomness(spark):
    rnd = random.Random(8)
    rows = [("".join(rnd.choice("0123456789abcdef") for _ in range(64)),) for _ in range(2000)]
    p = [r.p for r in spark.createDataFrame(rows, "t string").select(secrets.p_value(F.col("t")).alias("p")).collect()]
    assert 0.02 < sum(x < 0.05 for x in p) / len(p) < 0.10
    assert 0.38 < sum(x < 0.5 for x in p) / len(p) < 0.62


def test_redaction(spark):
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    df = spark.createDataFrame([(1, f'é token = "{key}" x', "", 1, 1), (2, None, "", 1, 1), (3, "clean", "", 1, 1), (4, f"{key} and password=abcdefghijklmn", "", 1, 1)], SCHEMA)
    got = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert got == {1: 'é [REDACTED]" x', 2: None, 3: "clean", 4: "[REDACTED] and [REDACTED]"}
    assert secrets.redact(df).columns == df.columns


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def statistics(text):
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    windows = [tuple(words[i : i + 8]) for i in range(n - 7)]
    count = Counter(windows)
    hit = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = n < 20 or 100 * len(hit) > 30 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed


def check_statistics(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        want = statistics(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want, texts[r.doc_id]
        assert not (r.kept and r.base_failed)


def test_statistics(spark, tmp_path):
    rnd = random.Random(2)
    texts = {0: None, 1: "", 2: " \n \x0b ", 3: "a b c d e f g h " * 3, 4: "x " * 5000, 5: "\n\n a\n a\n a \n", 6: "\x1cno\x85break"}
    for i in range(7, 300):
        texts[i] = "".join(rnd.choice(["a", "b", "é", "#", "word", "<|>", " ", " ", "\n", "\t"]) for _ in range(rnd.randint(0, 120)))
    spark.createDataFrame([(i, t, "clash", 1, 1) for i, t in texts.items()], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    check_statistics(queries.op8_quality(spark, str(tmp_path)).collect(), texts)


def test_table_statistics_and_verdicts(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op8_quality(spark, sf_dir).collect()
    check_statistics(rows, texts)
    good = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()}
    judged = [r for r in rows if r.doc_id in good and not r.base_failed]
    assert sum(r.kept for r in judged) >= 0.97 * len(judged)


def test_learning_finds_the_planted_rule():
    rnd = random.Random(3)
    rows = []
    for _ in range(1500):
        x = {f: rnd.random() for f in quality.FEATURES}
        rows.append((x, x["upper"] > 0.7 and x["digits"] <= 0.4))
    rules = quality.learn(rows)
    assert rules and sum(any(r.covers(x) for r in rules) == y for x, y in rows) > 0.97 * len(rows)
    assert quality.learn([]) == [] and quality.learn([(x, False) for x, _ in rows]) == []


def test_values_after_an_equals_sign(spark):
    rnd = random.Random(11)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    names = ["AWS_SECRET_ACCESS_KEY=", "SIGNING_KEY=", "https://a.example/x?sig="]
    values = ["".join(rnd.choice(b64) for _ in range(40)) + "=" * (i % 3) for i in range(60)]
    texts = [names[i % 3] + v for i, v in enumerate(values)]
    df = spark.createDataFrame([(i, t, "", 1, 1) for i, t in enumerate(texts)], SCHEMA)
    whole = {(i, t.index("=") + 1, len(t)) for i, t in enumerate(texts)}
    got = {(r.doc_id, x.start, x.end) for r in secrets.find_secrets(df).collect() for x in r.spans}
    assert got <= whole and len(got) >= 54
    clean = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert sum(clean[i] == names[i % 3] + "[REDACTED]" for i in clean) >= 54


def identifiers(rnd, n):
    """Ordinary strings of letters and digits such as texts are full of."""
    w = "the river some words user account section item report final image photo order invoice summary draft notes project chapter page table data model train".split()
    kinds = [
        lambda: "-".join(rnd.choices(w, k=3)) + f"-{rnd.randint(2000, 2025)}-{rnd.randint(10, 12)}-{rnd.randint(10, 28)}",
        lambda: f"IMG_{rnd.randint(2000, 2025)}0{rnd.randint(1, 9)}{rnd.randint(10, 28)}_{rnd.randint(0, 235959):06d}_{rnd.choice(w)}",
        lambda: "_".join(rnd.choices(w, k=4)) + f"_v{rnd.randint(1, 20)}",
        lambda: "/".join(rnd.choices(w, k=4)) + f"/{rnd.randint(1, 99999)}",
        lambda: "".join(x.capitalize() for x in rnd.choices(w, k=5)) + str(rnd.randint(1, 999)),
        lambda: f"order-{rnd.randint(10**9, 10**10)}-{rnd.randint(10**5, 10**6)}-{rnd.choice(w)}",
    ]
    return [x for x in (rnd.choice(kinds)() for _ in range(2 * n)) if len(x) >= 20][:n]


def test_precision_and_recall_on_a_whole_table(spark):
    """Planted keys and planted ordinary strings, one of either in every document."""
    rnd = random.Random(13)
    alphabets = ["0123456789abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"]
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    plain = identifiers(rnd, len(docs))
    rows, keys = [], set()
    for (i, text), name in zip(docs, plain):
        alphabet, n = rnd.choice(alphabets), rnd.choice([24, 32, 40, 64])
        key = "".join(rnd.choice(alphabet) for _ in range(n))
        head = f"{text[: len(text) // 2]} {name} "
        keys.add((i, len(head), len(head) + n))
        rows.append((i, f"{head}{key} {text[len(text) // 2 :]}", "", 1, 1))
    found = secrets.find_secrets(spark.createDataFrame(rows, SCHEMA).repartition(4)).select("doc_id", "spans").collect()
    got = {(r.doc_id, x.start, x.end) for r in found for x in r.spans if x.kind == "random"}
    assert len(got & keys) >= 0.9 * len(keys)
    assert len(got - keys) <= 0.1 * len(got)


def test_threshold_rises_with_ordinary_strings():
    even = [0] * (secrets.MOST_STEPS + 1)
    for k in range(120):
        even[k] = round(10_000 * (10 ** (-k / secrets.STEPS) - 10 ** (-(k + 1) / secrets.STEPS)))
    first = round(-math.log10(secrets.LEAST_P) * secrets.STEPS)
    assert secrets.threshold(even, 0.1) == first and secrets.threshold([0] * len(even), 0.1) == first
    mixed = [n + (400 if k >= 40 else 0) for k, n in enumerate(even)]
    assert 30 <= secrets.threshold(mixed, 0.1) < first
    ordinary = [n if k < 12 else n + 10_000 for k, n in enumerate(even)]
    assert secrets.threshold(ordinary, 0.1) <= 13


def test_secrets_of_odd_tables(spark):
    key = "KasaoSe1Nyez9gLghPyAAX7lbEJywO6O"
    df = spark.createDataFrame([(1, f"a {key} b", "mine", 7, 8)] * 3 + [(None, None, None, None, None), (2, "", "", 1, 1)], SCHEMA)
    df = df.withColumnsRenamed({"n_words": "base", "rule": "found"})
    out = secrets.find_secrets(df, out_col="x")
    assert out.columns == [*df.columns, "x"]
    rows = out.collect()
    assert [[(x.start, x.end, x.kind) for x in r.x] for r in rows if r.doc_id == 1] == [[(2, 34, "random")]] * 3
    assert {(r.spans, r.base, r.found) for r in rows if r.doc_id == 1} == {("mine", 7, 8)}
    assert [r.x for r in rows if r.doc_id != 1] == [[], []]
    assert secrets.find_secrets(df.limit(0), out_col="x").collect() == [] and secrets.redact(df.limit(0)).collect() == []
    assert {r.spans for r in secrets.redact(df).collect()} == {"mine", None, ""}


def test_quality_of_odd_tables(spark):
    schema = "doc_id long, text string, words string, sorted string, quality int"
    good, bad = "Plain words stand in this text, one after another. " * 5, "XX 11 YY 22 ## 33 ZZ ** " * 8
    rows = [(i, (good if i % 2 else bad) + f"number {i}", "w", "s", i % 2) for i in range(300)]
    rows += [(0, rows[0][1], "w", "s", 1), (0, rows[0][1], "w", "s", 0), (None, good, "w", "s", 0), (900, None, "w", "s", 0), (901, good, "w", "s", None)]
    df = spark.createDataFrame(rows, schema)
    rules = quality.learn_from(df.select("doc_id", "text"), df.select("doc_id", "quality"))
    assert rules
    out = quality.judge(df, rules)
    assert {"words", "sorted", "quality"} <= set(out.columns)
    judged = out.collect()
    assert {(r.words, r.sorted) for r in judged} == {("w", "s")} and len(judged) == len(rows)
    assert len({r.kept for r in judged if r.doc_id == 0}) == 1
    assert not any(r.kept for r in judged if r.text is None)
    assert quality.judge(df.limit(0), rules).collect() == []
    assert quality.learn_from(df.limit(0), df) == [] and quality.learn_from(df, df.limit(0)) == []


def test_rules_hold_on_labels_they_were_not_learned_from(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    rules = quality.learn_from(docs, labels.where(~held))
    judged = quality.judge(docs.join(labels.where(held & F.col("quality").isNotNull()).select("doc_id", "quality"), "doc_id"), rules).where("not base_failed").collect()
    good, bad = ([r.kept for r in judged if r.quality == q] for q in (1, 0))
    assert sum(good) >= 0.97 * len(good)
    assert len(bad) - sum(bad) >= 0.5 * len(bad)
