"""Language of texts: scripts narrow the candidates, then a Viterbi path over words labels spans.

Every word gets a score per language, the summed log-likelihood of its letter trigrams.
A language is a candidate for a word only if the word's script makes up at least
``SCRIPT_SHARE`` of the letters that it was learned from.  The best path over the words of
a text, with a penalty for every switch, gives spans of one language each.

Defined results: a text that is null or has no letter has no spans and the language
``und``; words of a script that no language uses leave all languages open; ties go to the
language that sorts first; repeated rows get equal results; an empty table gives an empty
result.  A corpus without labelled rows teaches nothing, and every text is ``und``.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.letters import batches, letters, runs
from tidemark.llm.words import mix

#: At most so many labelled documents are learned from, those with the least hash of their id.
FIT_DOCUMENTS = 20_000
SLOTS = 1 << 16
SCRIPT_SHARE = 0.01
SWITCH = 7.0
UNKNOWN = "und"

#: First code point of each stretch of Unicode blocks, and the script that prevails in it.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"), (0x07C0, "Nko"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"),
    (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"),
    (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"),
    (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Cherokee"), (0x1400, "Canadian"), (0x1780, "Khmer"),
    (0x1800, "Mongolian"), (0x1D00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x2C60, "Latin"),
    (0x2C80, "Other"), (0x2E80, "Han"), (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"),
    (0x3190, "Han"), (0xA000, "Yi"), (0xA4D0, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"),
    (0xF900, "Han"), (0xFB00, "Other"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Other"),
    (0x20000, "Han"), (0x32000, "Other"),
]
NAMES = sorted({name for _, name in SCRIPTS})
_FIRST = np.array([first for first, _ in SCRIPTS])
_NUMBER = np.array([NAMES.index(name) for _, name in SCRIPTS])


class Model(NamedTuple):
    languages: list[str]
    #: slots x languages: log-likelihoods, centred so that a trigram that tells nothing counts 0.
    weights: np.ndarray
    #: scripts x languages
    candidates: np.ndarray


def _trigrams(points: np.ndarray, slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """Where the letters are, and the slot of the trigram around each; neighbours that aren't letters count as one."""
    inner = np.zeros(len(points) + 2, np.uint64)
    inner[1:-1] = np.where(letters()[points], points, 0)
    at = np.flatnonzero(inner[1:-1])
    joint = inner[at] * np.uint64(1 << 42) + inner[at + 1] * np.uint64(1 << 21) + inner[at + 2]
    return at, (mix(joint) & np.uint64(slots - 1)).astype(np.int64)


def _scripts(points: np.ndarray) -> np.ndarray:
    return _NUMBER[np.searchsorted(_FIRST, points, side="right") - 1]


def fit(labelled: DataFrame, fit_documents: int = FIT_DOCUMENTS, seed: int = 1) -> Model:
    """Learn from (doc_id, text, lang); rows whose lang is null are left out.

    Counting runs as a Spark job; what reaches the driver is a table of languages x slots.
    """
    known = labelled.where("lang is not null and text is not null")
    chosen = known.select("doc_id").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(fit_documents).distinct()

    def count(parts):
        sums: dict[str, np.ndarray] = {}
        for part in parts:
            for lang, group in part.groupby("lang"):
                got = sums.setdefault(lang, np.zeros(SLOTS + len(NAMES), np.int64))
                for _, texts in batches(group["text"].tolist()):
                    for run in runs(texts):
                        at, slot = _trigrams(run.points)
                        got[:SLOTS] += np.bincount(slot, minlength=SLOTS)
                        got[SLOTS:] += np.bincount(_scripts(run.points[at]), minlength=len(NAMES))
        for lang, got in sums.items():
            slot = np.flatnonzero(got)
            yield pd.DataFrame({"lang": lang, "slot": slot, "n": got[slot]})

    found = known.select("doc_id", "lang", "text").join(F.broadcast(chosen), "doc_id", "left_semi").select("lang", "text")
    counts = found.mapInPandas(count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    table = np.zeros((SLOTS + len(NAMES), len(languages)))
    table[counts["slot"].to_numpy(np.int64), counts["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(np.int64)] = counts["n"]
    grams, scripts = table[:SLOTS], table[SLOTS:]
    logs = np.log(grams + 0.5) - np.log(grams.sum(0) + 0.5 * SLOTS)
    centred = logs - logs.mean(1, keepdims=True) if languages else logs
    return Model(languages, centred.astype(np.float32), scripts / np.maximum(scripts.sum(0), 1) >= SCRIPT_SHARE)


def best_paths(scores: np.ndarray, first: np.ndarray, count: np.ndarray, switch: float) -> np.ndarray:
    """Viterbi label of every word; texts are ``count`` words from ``first`` on, and all advance together word by word."""
    labels = np.zeros(len(scores), np.int8 if scores.shape[1] < 128 else np.int16)
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    first, count = first[count > 0], count[count > 0]
    if not len(first):
        return labels
    active = np.searchsorted(-count, -np.arange(1, count[0] + 1), side="right")  # texts that have a t-th word
    came = []
    state = scores[first].copy()
    for t in range(1, count[0]):
        n = active[t]
        state_n = state[:n]
        best = state_n.argmax(1)
        top = state_n[np.arange(n), best] - switch
        stay = state_n >= top[:, None]
        came.append(np.where(stay, -1, best[:, None]).astype(labels.dtype))
        state[:n] = np.maximum(state_n, top[:, None]) + scores[first[:n] + t]
    now = state.argmax(1)
    labels[first + count - 1] = now
    for t in range(count[0] - 1, 0, -1):
        n = active[t]
        back = came[t - 1][np.arange(n), now[:n]]
        now[:n] = np.where(back >= 0, back, now[:n])
        labels[first[:n] + t - 1] = now[:n]
    return labels


def _spans(model: Model, texts: list[str], switch: float):
    """Per word of all texts: index of the text, start and length in letters, language."""
    text, start, length, scores = [], [], [], []
    for run in runs(texts):
        if not len(run.start):
            continue
        at, slot = _trigrams(run.points)
        size = run.end - run.start
        summed = np.add.reduceat(model.weights[slot], np.cumsum(size) - size, axis=0)
        open_ = model.candidates[_scripts(run.points[run.start])]
        open_[~open_.any(1)] = True
        text.append(run.text)
        length.append(size)
        scores.append(np.where(open_, summed, summed - 50.0).astype(np.float32))
    if not text:
        return (np.zeros(0, np.int64),) * 3
    text, length, scores = (np.concatenate(x) for x in (text, length, scores))
    count = np.bincount(text, minlength=len(texts))
    return text, length, best_paths(scores, np.cumsum(count) - count, count, switch)


def predict(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """The columns of ``docs`` but text, with lang_pred, score (the share of letters in spans of that language)
    and spans: (language, words, letters) in order."""
    model_of = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema), "lang_pred string, score double, spans array<struct<language:string,words:int,letters:int>>"])

    def run(parts):
        model = model_of.value
        for part in parts:
            for begin, texts in batches(part["text"].tolist()):
                out = part.iloc[begin : begin + len(texts)][kept].copy()
                if not model.languages:
                    out["lang_pred"], out["score"], out["spans"] = UNKNOWN, 0.0, [[] for _ in texts]
                    yield out
                    continue
                text, length, label = _spans(model, texts, switch)
                by = np.bincount(text * len(model.languages) + label, weights=length, minlength=len(texts) * len(model.languages)).reshape(len(texts), -1)
                total = by.sum(1)
                best = by.argmax(1)
                out["lang_pred"] = [model.languages[b] if n else UNKNOWN for b, n in zip(best, total)]
                out["score"] = by.max(1) / np.maximum(total, 1)
                spans = [[] for _ in texts]
                if len(text):
                    head = np.flatnonzero(np.r_[True, (np.diff(text) != 0) | (np.diff(label) != 0)])
                    for t, l, w, n in zip(text[head], label[head], np.diff(np.r_[head, len(text)]), np.add.reduceat(length, head)):
                        spans[t].append((model.languages[l], int(w), int(n)))
                out["spans"] = spans
                yield out

    return docs.mapInPandas(run, schema)


def identify(docs: DataFrame, folds: int = 5) -> DataFrame:
    """Learn from the documents whose crc32(doc_id) mod ``folds`` isn't 0 and predict all: doc_id, held_out, lang_pred, score, spans."""
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds, F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"), (fold == 0).alias("held_out"))
    model = fit(rows.where("not held_out"))
    return predict(rows.select("doc_id", "text", "held_out"), model)
