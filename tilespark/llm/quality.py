"""Document statistics and learned decision lists of quality, in Spark SQL expressions.

Rules are learned by sequential covering.  A rule is a conjunction of thresholds on
statistics.  It is grown, condition by condition, by information gain on two thirds of
the labelled rows, then pruned from its end on the other third; it joins the list if it
is precise enough there, the rows that it covers leave, and the next one is grown.  The
list becomes one ordered ``CASE WHEN``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilespark.llm.common import fresh, settled

BLANK = r"[ \t-\r]+"
#: Labelled rows that rules are learned from, at most: those of the smallest hash of id.
LABELLED_ROWS = 6000

#: Name -> SQL over the statistics.
FEATURES = {
    "n_words": "n_words",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_words": "n_repeat_words / greatest(n_words, 1)",
    "upper": "n_upper / greatest(word_chars, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
    "exclaims": "n_exclaims / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "distinct_words": "n_distinct / greatest(n_words, 1)",
}
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_exclaims", "n_distinct")


def _without(text: Column, kept: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{kept}]+", "")).cast("long")


def with_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the columns ``STATISTICS`` (long); columns of these names are replaced.

    Words are separated by ASCII white space.  ``n_repeat_words`` counts the words in
    8-word windows that occur twice or more in the text.  A null text has no words.  All
    other columns stay, whatever their names.
    """
    text = F.coalesce(df[text_col], F.lit(""))
    word_list, line_list, hashes, by_hash = fresh([*df.columns, *STATISTICS], "words", "lines", "windows", "sorted")
    out = df.select(
        *(df[c] for c in df.columns if c not in STATISTICS),
        F.filter(F.split(text, BLANK, -1), lambda w: w != "").alias(word_list),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^ \t-\r]")).alias(line_list),
        _without(text, "#*$%&|<>").alias("n_symbols"),
        _without(text, "A-Z").alias("n_upper"),
        _without(text, "0-9").alias("n_digits"),
        _without(text, "!?").alias("n_exclaims"),
    )
    words, lines = F.col(word_list), F.col(line_list)
    out = out.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.length(F.array_join(words, "")).cast("long"),
            "n_distinct": F.size(F.array_distinct(words)).cast("long"),
            "n_lines": F.size(lines).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            hashes: F.when(F.size(words) >= 8, F.transform(F.sequence(F.lit(1), F.size(words) - 7), lambda i: F.xxhash64(F.slice(words, i, F.lit(8))))),
        }
    )
    windows = F.col(hashes)
    # only a text with a repeated window needs its places sorted
    out = out.withColumn(by_hash, F.when(F.size(F.array_distinct(windows)) < F.size(windows), F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    pairs = F.arrays_zip(
        F.col(by_hash).alias("x"),
        F.concat(F.array(F.lit(None).cast("long")), F.transform(by_hash, lambda s: s["h"])).alias("before"),
        F.slice(F.transform(by_hash, lambda s: s["h"]), F.lit(2), F.greatest(F.lit(1), F.size(by_hash))).alias("after"),
    )
    places = F.array_sort(F.transform(F.filter(pairs, lambda p: p["x"].isNotNull() & (p["x"]["h"].eqNullSafe(p["before"]) | p["x"]["h"].eqNullSafe(p["after"]))), lambda p: p["x"]["i"]))
    zero = F.lit(0)
    covered = F.aggregate(
        places,
        F.struct(zero.alias("n"), zero.alias("end")),
        lambda a, i: F.struct((a["n"] + (i + 8) - F.greatest(i, a["end"])).alias("n"), (i + 8).alias("end")),
        lambda a: a["n"],
    )
    out = out.withColumn("n_repeat_words", settled(F.when(F.col(by_hash).isNotNull(), covered).otherwise(0).cast("long")))
    return out.drop(word_list, line_list, hashes, by_hash)


BASE_FAILED = "n_words < 20 or 100 * n_repeat_words > 30 * n_words"


@dataclass
class Rule:
    """A conjunction of (feature, "<=" or ">", threshold)."""

    conditions: list[tuple[str, str, float]] = field(default_factory=list)

    def covers(self, row: dict[str, float]) -> bool:
        return all(row[f] <= t if op == "<=" else row[f] > t for f, op, t in self.conditions)

    def sql(self) -> str:
        return " and ".join(f"({FEATURES[f]}) {op} {t!r}D" for f, op, t in self.conditions)


def _thresholds(values: list[float], most: int = 48) -> list[float]:
    values = sorted(set(values))
    cuts = [(a + b) / 2 for a, b in zip(values, values[1:])]
    return cuts if len(cuts) <= most else [cuts[i * len(cuts) // most] for i in range(most)]


def _grow(rows: list[tuple[dict, bool]], conditions: int) -> Rule:
    """FOIL gain: positives kept times the information gained about each."""
    rule = Rule()
    while len(rule.conditions) < conditions:
        p, n = sum(y for _, y in rows), sum(not y for _, y in rows)
        if not p or not n:
            break
        now, best = math.log2(p / (p + n)), (0.0, None)
        for f in FEATURES:
            values = [(x[f], y) for x, y in rows]
            for t in _thresholds([v for v, _ in values]):
                low_p = sum(y for v, y in values if v <= t)
                low_n = sum(not y for v, y in values if v <= t)
                for op, q, m in (("<=", low_p, low_n), (">", p - low_p, n - low_n)):
                    if q and (gain := q * (math.log2(q / (q + m)) - now)) > best[0] + 1e-9:
                        best = (gain, (f, op, t))
        if best[1] is None:
            break
        rule.conditions.append(best[1])
        rows = [(x, y) for x, y in rows if Rule([best[1]]).covers(x)]
    return rule


def _worth(rule: Rule, rows: list[tuple[dict, bool]]) -> tuple[float, int, int]:
    p = sum(y for x, y in rows if rule.covers(x))
    n = sum(not y for x, y in rows if rule.covers(x))
    return (p - n) / (p + n) if p + n else -1.0, p, n


def learn(rows: list[tuple[dict, bool]], *, rules: int = 8, conditions: int = 4, precision: float = 0.95, support: int = 3) -> list[Rule]:
    """Rules for the rows marked True, each precise on rows it was not grown on."""
    grow = [r for k, r in enumerate(rows) if k % 3]
    prune = [r for k, r in enumerate(rows) if k % 3 == 0]
    out: list[Rule] = []
    while len(out) < rules:
        rule = _grow(grow, conditions)
        while len(rule.conditions) > 1 and _worth(Rule(rule.conditions[:-1]), prune)[0] >= _worth(rule, prune)[0]:
            rule = Rule(rule.conditions[:-1])
        _, p, n = _worth(rule, prune)
        _, gp, gn = _worth(rule, grow)
        if not rule.conditions or p < support or p + gp < precision * (p + n + gp + gn) or p < precision * (p + n):
            break
        out.append(rule)
        grow = [(x, y) for x, y in grow if not rule.covers(x)]
        prune = [(x, y) for x, y in prune if not rule.covers(x)]
    return out


def learn_from(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = LABELLED_ROWS) -> list[Rule]:
    """Rules for documents labelled 0, from at most ``most`` labelled rows.

    Rows with a null id or label teach nothing, nor do labels without a document; a null
    text is an empty one.  A document that is labelled twice counts twice, under either
    label if they conflict, and so do repeated documents.  Without documents or labels, or
    with labels of one kind, there are no rules.
    """
    picked = labels.where(labels[label_col].isNotNull() & labels[id_col].isNotNull()).select(labels[id_col].alias("id"), (labels[label_col] == 0).alias("bad"))
    picked = picked.orderBy(F.xxhash64("id"), "id").limit(most)
    docs = df.select(df[id_col].alias("id"), df[text_col].alias("text")).join(F.broadcast(picked), "id")
    found = with_statistics(docs).select("id", "bad", *(F.expr(sql).cast("double").alias(name) for name, sql in FEATURES.items()))
    rows = sorted(found.collect(), key=lambda r: (str(r.id)[::-1], r.bad))
    return learn([({f: r[f] for f in FEATURES}, r.bad) for r in rows])


def judge(df: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """``df`` with the statistics, ``base_failed``, the number of the rule that rejects the
    row (from 1; null if none does) and ``kept``.

    The first rule that fits decides.  Null and empty texts have no words and fail the base.
    A row is judged by its text alone, so repeated rows agree; an empty table stays empty.
    Columns of these names are replaced, all others stay.
    """
    out = with_statistics(df, text_col).withColumn("base_failed", F.expr(BASE_FAILED))
    which = "cast(null as int)"
    if rules:
        which = "case " + " ".join(f"when {r.sql()} then {k}" for k, r in enumerate(rules, 1)) + " end"
    out = out.withColumn("rule", F.expr(which))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
