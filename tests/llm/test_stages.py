"""Pipeline stages against plain Python on their own input."""

from __future__ import annotations

import re
from collections import Counter
from hashlib import md5

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from arborlake.llm import toxicity

from .conftest import DOCUMENTS

SMALL = "/root/testdata/sf0.001"


def copies(rows):
    """How often the mix takes each of the rows ``doc_id, text, source``."""

    def hexed(text):
        return md5(text.encode()).hexdigest()

    by_source, found = {}, Counter()
    for i, text, source in rows:
        size = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        u = int(hexed(f"42:{'' if i is None else i}:{'' if text is None else hexed(text)}")[:13], 16)
        by_source.setdefault((source is None, source or ""), []).append((u, size, i))
    words = {s: sum(size for _, size, _ in own) for s, own in by_source.items()}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(words))}
    target, free = {}, set(words)
    while free:
        left, among = sum(words.values()) - sum(target.values()), sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * left > 3 * words[s] * among}
        if not over:
            break
        target |= {s: 3 * words[s] for s in over}
        free -= over
    target |= {s: weight[s] * left / among for s in free}
    for s, own in by_source.items():
        whole, rest = divmod(int(target[s] + 0.5), words[s]) if words[s] else (0, 0)
        cut, part, before = -1, 0, 0
        for u in sorted({u for u, _, _ in own}):
            drawn = [size for v, size, _ in own if v == u]
            if before <= rest < before + sum(drawn):
                cut, part = u, (rest - before) // len(drawn)
            before += sum(drawn)
        for u, size, i in own:
            found[i] += whole + (u < cut or (u == cut and 2 * part >= size))
    return +found


@pytest.fixture(scope="module")
def inputs(llm_spark, odd_rows):
    return [llm_spark.read.parquet(f"{SMALL}/documents.parquet"), llm_spark.createDataFrame(odd_rows, DOCUMENTS)]


def test_mixing_equals_plain_python(llm_spark, inputs):
    for docs in inputs:
        taken = corpus_pipeline.mix_sources(llm_spark, docs, SMALL)
        assert taken.columns == docs.columns
        want = copies([tuple(r) for r in docs.select("doc_id", "text", "source").collect()])
        assert Counter(r.doc_id for r in taken.select("doc_id").collect()) == want


def test_toxicity_keeps_what_scores_below_the_limit(llm_spark, inputs):
    labels = llm_spark.read.parquet(f"{SMALL}/labels.parquet")
    for docs in inputs:
        kept = corpus_pipeline.reject_toxic(llm_spark, docs, SMALL)
        assert kept.columns == docs.columns
        score = toxicity.scorer(docs, labels)(F.col("text"))
        scored = docs.select("doc_id", "text", score.alias("found")).collect()
        want = Counter((r.doc_id, r.text) for r in scored if r.found < toxicity.REJECT_SCORE)
        assert Counter((r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()) == want


def test_toxicity_stage_on_labelled_rows(llm_spark):
    """On 449 toxic rows. Fits on few labels find less: 4 of 11 and 12 of 51 toxic rows stay on the smaller tables."""
    folder = "/root/testdata/sf0.1"
    docs = llm_spark.read.parquet(f"{folder}/documents.parquet")
    labels = llm_spark.read.parquet(f"{folder}/labels.parquet")
    toxic, clean = ({r.doc_id for r in labels.where(F.col("toxic") == k).collect()} for k in (1, 0))
    left = {r.doc_id for r in corpus_pipeline.reject_toxic(llm_spark, docs, folder).select("doc_id").collect()}
    assert len(clean & left) >= 0.98 * len(clean), (len(clean & left), len(clean))
    assert len(toxic & left) <= 0.2 * len(toxic), (len(toxic & left), len(toxic))
