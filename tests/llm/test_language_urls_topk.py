"""Language identification, URL filters and top-k search."""

import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilespark.llm import language, queries, topk, urls

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("score", T.StringType())])


def test_gradients_are_those_of_the_loss():
    net = language.Network.fresh(["a", "b", "c"], hidden=3, seed=1)
    for name in ("x", "u", "c", "w", "b"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    rnd = np.random.default_rng(0)
    data, label = rnd.integers(97, 100, (6, 5)).astype(np.uint8), rnd.integers(0, 3, 5)
    mask = (rnd.random((6, 5)) > 0.2).astype(float)
    _, grads = net.gradients(data, label, mask)
    for w, g, at in zip(net.weights(), grads, ([(0, 98, 1), (1, 97, 5), (1, 99, 7)], [(0, 1, 2), (1, 0, 4)], [(0, 1, 1), (1, 2, 0)], [(0, 1), (4, 2)], [(1,)])):
        for i in at:
            was, eps = w[i], 1e-3
            w[i] = was + eps
            up = net.gradients(data, label, mask)[0]
            w[i] = was - eps
            down = net.gradients(data, label, mask)[0]
            w[i] = was
            assert abs((up - down) / (2 * eps) - g[i]) < 2e-3


def test_held_out_accuracy_and_contract(spark, sf_dir):
    rows = queries.op2_language(spark, "/root/testdata/sf0.01").collect()
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.97 * len(held)


def test_language_of_odd_rows(spark, tmp_path):
    rnd = random.Random(1)

    def words(letters, n=60):
        return " ".join("".join(rnd.choice(letters) for _ in range(5)) for _ in range(n))

    rows = [(i, words("abcde" if i % 2 else "vwxyz"), "l1" if i % 2 else "l2", "clash") for i in range(120)]
    rows += [(500, None, "l1", ""), (501, "", "l1", ""), (502, "12 345 !", None, ""), (503, words("abcde", 40_000), None, ""), (504, "v", None, ""), (None, words("vwxyz"), None, ""), (1, rows[1][1], "l1", "")]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op2_language(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i in (500, 501, 502):
        assert (by[i].lang_pred, by[i].score) == ("und", 0.0)
    assert by[503].lang_pred == "l1" and by[None].lang_pred == "l2" and not by[None].held_out
    assert sum(r.lang_pred == ("l1" if r.doc_id % 2 else "l2") for r in got if r.doc_id is not None and r.doc_id < 120) >= 119
    blank = spark.createDataFrame([(1, "some text", None, "")], DOCS)
    assert [r.lang_pred for r in language.identify(blank, language.fit(blank)).collect()] == ["und"]
    assert language.identify(blank.limit(0), language.fit(blank)).collect() == []


def by_hand(net, text):
    """Mean distribution over a text's positions, one position and one gate at a time."""
    h_size, total = net.c.shape[1], np.zeros(len(net.labels))
    logistic = lambda v: 1 / (1 + np.exp(-v))

    def states(data, k):
        h, out = np.zeros(h_size), []
        for byte in data:
            x = net.x[k, byte].astype(float)
            gates = logistic(x[: 2 * h_size] + h @ net.u[k])
            z, r = gates[:h_size], gates[h_size:]
            n = np.tanh(x[2 * h_size :] + (r * h) @ net.c[k])
            h = (1 - z) * h + z * n
            out.append(h)
        return out

    for a in range(0, len(text), language.STRIP):
        window = [text[i] if 0 <= i < len(text) else 32 for i in range(a - language.CONTEXT, a + language.STRIP + language.CONTEXT)]
        there, back = states(window, 0), states(window[::-1], 1)[::-1]
        for i in range(a, min(len(text), a + language.STRIP)):
            k = i - a + language.CONTEXT
            logits = np.concatenate([there[k], back[k]]) @ net.w + net.b
            e = np.exp(logits - logits.max())
            total += e / e.sum()
    return total / max(1, len(text))


def test_pooled_probabilities_by_hand():
    net = language.Network.fresh(["a", "b", "c"], hidden=3, seed=5)
    rnd = random.Random(9)
    texts = [bytes(rnd.randrange(32, 250) for _ in range(n)) for n in (0, 1, 15, 127, 128, 129, 300, 700)]
    for lanes in (3, 2048):
        language.LANES, kept = lanes, language.LANES
        got = language.pooled(net, texts)
        language.LANES = kept
        assert np.abs(got - np.stack([by_hand(net, x) for x in texts])).max() < 1e-5


def test_labels_of_the_table_by_hand(spark, sf_dir):
    """``lang_pred`` and ``score`` of short texts of the table, beside columns of clashing names."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = language.fit(docs)
    few = docs.where("length(text) < 400").withColumns({"label": F.lit("x"), "score": F.lit("y"), "__letter": F.lit("z")})
    rows = language.identify(few, net).collect()
    assert rows and {(r.label, r["__letter"]) for r in rows} == {("x", "z")}
    for r in rows:
        if any(c.isalpha() for c in r.text):
            p = by_hand(net, r.text.encode())
            assert abs(r.score - p.max()) < 1e-4 and p[net.labels.index(r.lang_pred)] > p.max() - 1e-4
        else:
            assert (r.lang_pred, r.score) == ("und", 0.0)


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def ruled(host, path):
    best = None
    for verdict, rule in RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return best


def check_urls(rows, pages):
    assert len(rows) == len(pages)
    for r in rows:
        host, path = parts(pages[r.page_id])
        assert (r.host, r.path) == (host, path), pages[r.page_id]
        rule = ruled(host, path)
        assert r.rule == (rule[1] if rule else None) and r.verdict in ("allow", "block")
        if rule:
            assert r.verdict == rule[0]


def test_urls_of_the_table(spark, sf_dir):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    check_urls(queries.op3_url_filter(spark, sf_dir).collect(), pages)


def test_rules_do_not_decide_beyond_themselves(spark):
    """Ends of hosts that rules name have no statistics, and what no rule decides is blocked
    on evidence only."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    src = urls.with_parts(pages)
    verdict = urls.rule_columns()[1]
    trees = urls.fit(src, "url", verdict == "block", blind=urls.named_suffixes())
    assert urls.named_suffixes() == {"com", "net"} and not {"com", "net"} & set(trees.rates)
    got = urls.judge_urls(pages.withColumn("f_length", F.lit("mine"))).collect()
    open_ = [r for r in got if r.rule is None]
    assert {r.f_length for r in got} == {"mine"} and 0 < len(open_)
    assert sum(r.verdict == "block" for r in open_) <= 0.3 * len(open_)


def test_odd_urls(spark, tmp_path):
    odd = [None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.COM/en/x", "http://example.com/en/", "http://example.com/en", "http://x.example.com/en/?q#f", "a://b.net/es/://c.com/", "http://É.Net/fr/1", "http://notcom/", "http://com/", "http://net?/es/", "http://h#/x", "http://a.com\n/x", "http://u:p@b.com:80/z?a=1&b=2", "http://e.com/" + "x" * 50_000]
    pages = dict(enumerate(odd))
    spark.createDataFrame([(i, u, "h", "clash") for i, u in pages.items()] + [(1, "", "h", "c")], "page_id long, url string, host string, rule string").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op3_url_filter(spark, str(tmp_path)).collect()
    check_urls(list({r.page_id: r for r in got}.values()), pages)
    assert len(got) == len(odd) + 1
    spark.createDataFrame([], "page_id long, url string").write.parquet(f"{tmp_path}/none/pages.parquet")
    assert queries.op3_url_filter(spark, f"{tmp_path}/none").collect() == []


def test_trees_learn_what_rules_do_not_say(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(1500):
        bad = rnd.random() < 0.4
        host = "".join(rnd.choice("abcdefgh" + ("0123456789" if bad else "")) for _ in range(12))
        rows.append((i, f"http://{host}.{rnd.choice(['org', 'io'])}/{'x/' * rnd.randint(1, 4)}", bad))
    df = urls.with_parts(spark.createDataFrame(rows, "id long, url string, bad boolean"))
    learn, rest = df.where("id % 3 > 0"), df.where("id % 3 = 0")
    trees = urls.fit(learn, "url", F.col("bad"))
    got = urls.judge_urls(rest, rules=(), trees=trees).collect()
    assert sum((r.verdict == "block") == r.bad for r in got) >= 0.95 * len(got)
    x = np.random.default_rng(0).random((300, len(urls.FEATURES)))
    base, found = urls.boost(x, (x[:, 3] > 0.5).astype(float))
    assert ((urls.Trees(base, found, {}, 0).predict(x) > 0.5) != (x[:, 3] > 0.5)).mean() < 0.02


def brute_top(rows, k=20):
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v in ok), default=0)
    m = np.array([v + [0] * (width - len(v)) for _, v in ok], np.int64).reshape(len(ok), width)
    ids = np.array([i for i, _ in ok])
    out = set()
    for q in {int(i) for i in ids if i % 20 == 0}:
        row = m[np.flatnonzero(ids == q)[0]]
        score = m @ row
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:k]
        out |= {(q, r, int(ids[j]), int(score[j])) for r, j in enumerate(order, 1)}
    return out


def test_top_k_of_the_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = queries.op9_top_k(spark, sf_dir).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == brute_top(rows) and len(got) == len(brute_top(rows))


def test_top_k_with_ties_and_odd_vectors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    rnd = random.Random(4)
    same = [0.5, -0.25, 0.125, 1.0]
    rows = [(i, same if i % 3 == 0 else [rnd.choice([-1.0, -0.5, 0.0, 0.3, 2.0]) for _ in range(4)]) for i in range(400)]
    rows += [(400, None), (420, []), (440, [None, 1.0, 1.0, 1.0]), (460, [float("nan")] * 4), (480, [float("inf")] * 4), (401, [9.0]), (None, same), (500, [0.0] * 4), (502, [100.0, -100.0, 3.5, 7.0])]
    schema = "vec_id long, embedding array<float>, score string, norm string"
    spark.createDataFrame([(i, v, "clash", "clash") for i, v in rows], schema).repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op9_top_k(spark, str(tmp_path)).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == brute_top(rows)
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, vector array<float>")
    assert [tuple(r) for r in topk.exact_top_k(few, 20, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2.0)]
    assert topk.exact_top_k(few.limit(0), 20, F.col("vec_id") == 0).collect() == []


def test_bounds_prune_but_keep_the_answer():
    rnd = np.random.default_rng(3)
    v = (rnd.normal(size=(500, 32)) * np.geomspace(60, 1, 32)).round()
    _, rotation = np.linalg.eigh(v.T @ v)
    q = v[:40]
    ids = np.arange(500)
    a, b, s = topk.meet(q, ids[:40], np.full(40, -np.inf), v, ids, rotation[:, ::-1], 5)
    for i in range(40):
        score = v @ q[i]
        want = [j for j in np.lexsort((ids, -score)) if j != i][:5]
        assert list(b[a == i]) == want
