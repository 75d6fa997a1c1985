"""Line-first quality rules.

Each line that holds a word is judged alone: it fails if it repeats an earlier line of its
text, is navigation (few words between its separators, a row of sentences of hardly a word each, or mostly links), is
boilerplate (stock phrases, whole words, make up much of it), is heavy with symbols, or is prose without closing
punctuation: it neither ends with a closing sign nor holds the end of a sentence. Separators at the head of a
line are a bullet and count as nothing. How long a line is decides nothing: all rules are about shares.
Failing lines are removed; a document that loses more than `max_lost` of its word characters is rejected.

Nulls and empty texts have no words: all counts 0, base_failed true, kept false, cleaned text
empty. Repeated rows are judged each for itself; extra columns are left out of the result.
An empty table gives an empty result. Texts of any length are judged whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
ENDS = tuple(".!?…:;\"'”’»)]。！？")
INNER = (". ", "! ", "? ", "。", "！", "？")  # ends of sentences within a line
LINKS = ("://", "www.")
SEPARATORS = ("|", "»", "›", "•", "·", "→", ">")
#: Lower-case words, letters only, in the languages that sites are kept in most.
STOCK = (
    "all rights reserved", "accept cookies", "accept all cookies", "cookie policy", "privacy policy", "terms of use", "terms of service", "enable javascript",
    "sign up for", "subscribe to our", "click here", "skip to content", "back to top", "read more", "share this", "log in", "follow us",
    "alle rechte vorbehalten", "impressum", "datenschutz", "cookies akzeptieren", "nutzungsbedingungen", "mehr lesen", "nach oben", "jetzt anmelden", "folgen sie uns",
    "tous droits réservés", "mentions légales", "accepter les cookies", "politique de confidentialité", "conditions d utilisation", "lire la suite", "haut de page", "suivez nous",
    "todos los derechos reservados", "aviso legal", "aceptar cookies", "política de privacidad", "términos de uso", "leer más", "volver arriba", "síguenos",
)
_TOKEN, _LETTERS = re.compile(r"[^\x20\x09-\x0D]+"), regex.compile(r"\p{L}+")
_STOCK = tuple((f" {s} ", len(s.split())) for s in STOCK)


@dataclass(frozen=True)
class Rules:
    """min_words and most_repeat are the base rules; the others are the line rules."""

    min_words: int = 50
    most_repeat: int = 50  # per cent of words in repeated 3-word windows
    nav_words: int = 3  # words between two separators, at most, of navigation
    nav_sentences: int = 4  # so many sentences at least, of three words for two of them at most, are navigation
    most_stock: int = 25  # per cent of a line's words
    most_symbols: float = 0.1  # of a line's word characters
    most_links: float = 0.5  # of a line's words
    max_lost: float = 0.4  # of a document's word characters


def word_chars(text: str) -> int:
    return len(text) - sum(map(text.count, SPACES))


def repeated_windows(codes: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Words in 3-word windows that their document holds twice or more, counted by document.

    codes: the words of several documents, one after another, as integers; doc: ascending."""
    if len(codes) < 3:
        return np.zeros(n_docs, np.int64)
    c = codes.astype(np.int64)
    m = int(c.max()) + 1
    pair = c[:-2] * m + c[1:-1]
    if m >= 1 << 21:  # three codes don't fit into 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair * m + c[2:]
    at = np.flatnonzero(doc[:-2] == doc[2:])
    order = at[np.argsort(key[at], kind="stable")]  # within a key by place, so by document
    same = (key[order[1:]] == key[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    hit = np.zeros(len(order), bool)
    hit[1:] |= same
    hit[:-1] |= same
    covered = np.zeros(len(c), bool)
    for k in range(3):
        covered[order[hit] + k] = True
    return np.bincount(doc[covered], minlength=n_docs)


def lines_of(text: str, r: Rules) -> tuple[list[str], int, int]:
    """The lines that pass, the number of repeated lines, and the word characters that pass."""
    seen, kept, repeats, chars = set(), [], 0, 0
    for line in text.split("\n"):
        bare = line.strip(SPACES)
        if not bare:
            continue
        if line in seen:
            repeats += 1
            continue
        seen.add(line)
        n = word_chars(bare)
        if sum(map(bare.count, SYMBOLS)) > r.most_symbols * n or not bare.endswith(ENDS) and not any(s in bare for s in INNER):
            continue
        tokens = _TOKEN.findall(bare)
        words, inner = len(tokens), bare.lstrip(SPACES + "".join(SEPARATORS))
        signs = sum(map(inner.count, SEPARATORS))
        if signs and sum(bool(w.strip("".join(SEPARATORS))) for w in _TOKEN.findall(inner)) <= r.nav_words * (signs + 1):
            continue
        sentences = sum(w.endswith((".", "!", "?")) for w in tokens)
        if sentences >= r.nav_sentences and 2 * words <= 3 * sentences:
            continue
        plain = _LETTERS.findall(bare.lower())
        line_ = f" {' '.join(plain)} "
        if 100 * sum(line_.count(s) * n for s, n in _STOCK) > r.most_stock * len(plain):
            continue
        if sum(map(bare.count, LINKS)) > r.most_links * words:
            continue
        kept.append(line)
        chars += n
    return kept, repeats, chars


def judge(texts: list[str | None], r: Rules) -> dict[str, list]:
    texts = [t or "" for t in texts]
    split = [t.encode().split() for t in texts]
    n = np.array([len(w) for w in split], np.int64)
    codes = pd.factorize(np.array([w for ws in split for w in ws], object))[0] if n.sum() else np.zeros(0, np.int64)
    repeat = repeated_windows(codes, np.repeat(np.arange(len(texts)), n), len(texts))
    found = [lines_of(t, r) for t in texts]
    chars = [word_chars(t) for t in texts]
    base = (n < r.min_words) | (100 * repeat > r.most_repeat * n)
    lost = [1 - f[2] / c if c else 1.0 for f, c in zip(found, chars, strict=True)]
    return {
        "n_words": n, "word_chars": chars, "n_symbols": [sum(map(t.count, SYMBOLS)) for t in texts], "n_dup_lines": [f[1] for f in found],
        "n_repeat_words": repeat, "base_failed": base, "lost": lost, "kept": [bool(not b and x <= r.max_lost) for b, x in zip(base, lost, strict=True)],
        "cleaned": ["\n".join(f[0]) for f in found],
    }


OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, lost double, kept boolean"
_ARROW = [(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [("base_failed", pa.bool_()), ("lost", pa.float64()), ("kept", pa.bool_())]


@common.task()
def _rules(batches, rules: Rules, with_text: bool):
    """The text comes last; the columns before it go through."""
    for batch in batches:
        carry = batch.num_columns - 1
        texts = batch.column(carry).to_pylist()
        for a, b in common.slices(texts, 4_000_000):
            got = judge(texts[a:b], rules)
            cols = [batch.column(i).slice(a, b - a) for i in range(carry)] + [pa.array(got[k], t) for k, t in _ARROW]
            if with_text:
                cols.append(pa.array(got["cleaned"], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=[f"c{i}" for i in range(len(cols))])


def quality(docs: DataFrame, rules: Rules = Rules(), text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_text: bool = True) -> DataFrame:
    """One row per document: the columns of `keep`, the counts, `lost`, `kept` and, unless left out, the cleaned text.

    A column of `keep` with the name of a result column gives way to it."""
    common.ship(docs.sparkSession)
    new = OUT + ", cleaned string" * with_text
    names = [x.split()[0] for x in new.split(", ")]
    keep = [c for c in keep if c not in names]
    kinds = [f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)] + [f"c{len(keep) + i} {x.split()[1]}" for i, x in enumerate(new.split(", "))]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(text).alias(f"c{len(keep)}"))
    return rows.mapInArrow(partial(_rules, rules=rules, with_text=with_text), ", ".join(kinds)).toDF(*keep, *names)
