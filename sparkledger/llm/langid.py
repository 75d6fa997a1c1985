"""Language identification in two steps: the family first, then the language within it.

A linear support vector machine per family (one against the rest) picks the family; within it,
one-versus-one machines for each pair of languages vote, ties going to the larger sum of
margins. Features are hashed byte 2- and 3-grams of the lower-cased text. The machines are
fitted on a bounded sample of labelled rows, by Spark tasks, one machine each; prediction
reads every whole text.

Languages that `FAMILIES` doesn't name form a family of their own. Null texts and texts without
a letter are `und` with score 0. With a single learned language, it is predicted with score 1;
with none, all are `und`. Repeated rows are predicted each alone; an empty table gives an empty
result; columns other than the id and the text play no part in a prediction.
"""

from __future__ import annotations

import json
import re
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Families of ISO 639-1 codes.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "pl", "cs", "uk", "bg", "sr", "hr", "sk"),
}
BITS = 13
DRAWS = 1 << 62
MAY_BE_LETTER = re.compile(r"[^\W\d_]")  # fractions and other signs of number among them


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m[0].isalpha() for m in MAY_BE_LETTER.finditer(text))


def family(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


def grams(data: np.ndarray) -> np.ndarray:
    """Buckets of the 2- and 3-grams that start at each byte but the last two, one after another."""
    b = data.astype(np.uint32)
    two = b[:-2] * np.uint32(257) + b[1:-1]
    three = two * np.uint32(263) + b[2:]
    top = np.uint32(32 - BITS)
    return np.concatenate([(two * np.uint32(2654435761)) >> top, (three * np.uint32(2246822519)) >> top])


def bytes_of(text: str) -> bytes:
    return (" " + " ".join(text.lower().split()) + " ").encode()


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that the text fills, ascending, and the roots of their shares."""
    g = grams(np.frombuffer(bytes_of(text), np.uint8))
    n = np.bincount(g, minlength=1 << BITS)
    at = np.flatnonzero(n)
    return at, np.sqrt((n[at] / max(len(g), 1)).astype(np.float32)) * np.float32(8)


@common.task()
def _sampled(batches):
    for pdf in batches:
        pdf = pdf[[has_letter(t) for t in pdf["text"]]]
        if len(pdf):
            at, x = zip(*map(features, pdf["text"]), strict=True)
            yield pd.DataFrame({"lang": pdf["lang"].to_list(), "draw": pdf["draw"].to_list(), "at": [a.astype(np.int16) for a in at], "x": list(x)})


def svm(at: list[np.ndarray], x: list[np.ndarray], y: np.ndarray, rounds: int = 40, c: float = 10.0, seed: int = 7) -> np.ndarray:
    """L2-regularised hinge loss by dual coordinate descent; the last weight is the bias.

    at, x: of each row the places that are not zero, and what stands there."""
    bias, one = np.array([1 << BITS]), np.ones(1, np.float32)
    at, x = [np.concatenate([v.astype(np.int64), bias]) for v in at], [np.concatenate([v, one]) for v in x]
    w, a, q = np.zeros((1 << BITS) + 1, np.float32), np.zeros(len(x)), [float(v @ v) for v in x]
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(x)):
            g = y[i] * float(x[i] @ w[at[i]]) - 1
            new = min(max(a[i] - g / q[i], 0.0), c)
            if new != a[i]:
                w[at[i]] += np.float32((new - a[i]) * y[i]) * x[i]
                moved = max(moved, abs(new - a[i]))
                a[i] = new
        if moved < 1e-3:
            break
    return w


def machines(langs: list[str]) -> list[dict]:
    """What is to be fitted: families against the rest, then pairs within a family."""
    groups: dict[str, list[str]] = {}
    for x in sorted(langs):
        groups.setdefault(family(x), []).append(x)
    out = []
    if len(groups) > 1:
        out += [{"kind": "family", "name": g, "yes": m, "no": [x for x in langs if x not in m]} for g, m in sorted(groups.items())]
    for g, m in sorted(groups.items()):
        out += [{"kind": "pair", "name": g, "yes": [a], "no": [b]} for a, b in combinations(m, 2)]
    return out


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    job = json.loads(pdf["job"].iloc[0])
    pdf = pdf.sort_values(["draw", "lang"], kind="stable")  # in whatever order the rows come, the machine is the same
    w = svm(pdf["at"].to_list(), pdf["x"].to_list(), np.where(pdf["lang"].isin(job["yes"]), 1.0, -1.0))
    return pd.DataFrame({"job": [pdf["job"].iloc[0]], "w": [w.tolist()]})


def train(docs: DataFrame, per_language: int = 600, most_languages: int = 1000, text: str = "text", lang: str = "lang", id: str = "doc_id") -> dict:
    """Fit on at most about `per_language` labelled rows of each language, chosen by a hash of the id and the text.

    Rows with equal ids and texts are one row of the sample, so that rows without an id can't swell it.
    The bound is what makes one task per machine enough. Each language with at least one row is learned: with more
    of them than `most_languages` (a column of labels that are no languages, say) a ValueError is raised."""
    spark = docs.sparkSession
    common.ship(spark)
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.pmod(F.xxhash64(id, text), F.lit(DRAWS)).alias("draw")).filter("lang IS NOT NULL AND text IS NOT NULL AND length(text) > 0")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(most_languages + 1).collect()
    if not counts:
        return {"langs": [], "jobs": [], "w": []}
    if len(counts) > most_languages:
        raise ValueError(f"over {most_languages} languages")
    share = spark.createDataFrame([(r["lang"], DRAWS * min(per_language, r["n"]) // r["n"]) for r in counts], "lang string, share long")
    drawn = rows.join(F.broadcast(share), "lang").filter("draw < share").groupBy("draw", "lang").agg(F.first("text").alias("text"))
    x = common.table(spark, drawn.repartition(8).mapInPandas(_sampled, "lang string, draw long, at array<short>, x array<float>"), "langid-sample")
    langs = sorted(r["lang"] for r in x.select("lang").distinct().collect())
    jobs = machines(langs)
    if not jobs:
        return {"langs": langs, "jobs": [], "w": []}
    todo = spark.createDataFrame([(json.dumps(j), y) for j in jobs for y in j["yes"] + j["no"]], "job string, lang string")
    got = {r["job"]: np.array(r["w"], np.float32) for r in x.join(F.broadcast(todo), "lang").select("job", "lang", "draw", "at", "x").groupBy("job").applyInPandas(_fit, "job string, w array<float>").collect()}
    return {"langs": langs, "jobs": jobs, "w": [got[json.dumps(j)] for j in jobs]}


def decide(margins: np.ndarray, model: dict) -> tuple[list[str], np.ndarray]:
    """margins: documents x machines."""
    n = len(margins)
    jobs = model["jobs"]
    fam = [j for j, m in enumerate(jobs) if m["kind"] == "family"]
    groups = [jobs[j]["name"] for j in fam] or [family(model["langs"][0])]
    pick = margins[:, fam].argmax(1) if fam else np.zeros(n, int)
    sure = 1 / (1 + np.exp(-2 * margins[np.arange(n), [fam[p] for p in pick]])) if fam else np.ones(n)
    langs, score = np.empty(n, object), np.zeros(n)
    for g, name in enumerate(groups):
        rows = np.flatnonzero(pick == g)
        members = [x for x in model["langs"] if family(x) == name]
        votes, sums = np.zeros((len(rows), len(members))), np.zeros((len(rows), len(members)))
        for j, m in enumerate(jobs):
            if m["kind"] == "pair" and m["name"] == name:
                a, b, d = members.index(m["yes"][0]), members.index(m["no"][0]), margins[rows, j]
                votes[:, a] += d >= 0
                votes[:, b] += d < 0
                sums[:, a] += d
                sums[:, b] -= d
        best = np.lexsort((sums, votes), axis=1)[:, -1]
        langs[rows] = np.array(members, object)[best]
        near = 1 / (1 + np.exp(-2 * sums[np.arange(len(rows)), best] / max(len(members) - 1, 1))) if len(members) > 1 else 1.0
        score[rows] = sure[rows] * near
    return list(langs), score


def margins_of(texts: list[str], w: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """w: buckets x machines."""
    out = np.empty((len(texts), w.shape[1]))
    for i, t in enumerate(texts):
        at, x = features(t)
        out[i] = x @ w[at] + bias
    return out


@common.task()
def _predict(batches, model: dict):
    """The text comes last; the columns before it go through."""
    w = np.stack(model["w"], 1) if model["w"] else None
    for batch in batches:
        carry = batch.num_columns - 1
        texts = batch.column(carry).to_pylist()
        lang, score = ["und"] * len(texts), np.zeros(len(texts))
        rows = [i for i, t in enumerate(texts) if has_letter(t)] if model["langs"] else []
        if rows and w is None:
            for i in rows:
                lang[i], score[i] = model["langs"][0], 1.0
        elif rows:
            got, sure = decide(margins_of([texts[i] for i in rows], w[:-1], w[-1]), model)
            for i, x, s in zip(rows, got, sure, strict=True):
                lang[i], score[i] = x, s
        cols = [*(batch.column(i) for i in range(carry)), pa.array(lang, pa.string()), pa.array(score, pa.float64())]
        yield pa.RecordBatch.from_arrays(cols, names=[f"c{i}" for i in range(len(cols))])


def predict(docs: DataFrame, model: dict, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: the columns of `keep`, lang_pred, score (which replace columns of their names)."""
    common.ship(docs.sparkSession)
    keep = [c for c in keep if c not in ("lang_pred", "score")]
    kinds = [f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)] + [f"c{len(keep)} string", f"c{len(keep) + 1} double"]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(text).alias(f"c{len(keep)}"))
    return rows.mapInArrow(partial(_predict, model=model), ", ".join(kinds)).toDF(*keep, "lang_pred", "score")
