"""Each stage of the pipeline on its own input, against plain versions."""

from __future__ import annotations

import duckdb
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.session import stage
from test_text_operators import least_reachable, plain_spans, shingles

FOLDER = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept = docs.columns, [{r.doc_id: r for r in docs.collect()}]
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = stage(step(spark, docs, FOLDER), "test")
        assert docs.columns == columns
        rows = docs.collect()
        kept.append({r.doc_id: r for r in rows})
        assert len(rows) == len(kept[-1]) and kept[-1].keys() <= kept[-2].keys()
    _, good, known, unlike, safe = kept
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{FOLDER}/labels.parquet'").fetchall())
    assert all(i in good for i, q in labels.items() if q == 1)
    bad = [i for i, q in labels.items() if q == 0]
    assert sum(i not in good for i in bad) >= 0.6 * len(bad)  # few texts to learn from at this size
    assert len(known) >= 0.95 * len(good)
    sets = [(i, shingles(r.text)) for i, r in sorted(known.items())]
    label = least_reachable([(i, s) for i, s in sets if s], 80)
    assert set(unlike) == {i for i in known if label.get(i, i) == i}
    for i, r in unlike.items():
        text, at = "", 0
        for start, end in sorted((a, b) for a, _, b in plain_spans(r.text or "")):
            text += (r.text[at:start] + "[SECRET]") if start >= at else ""
            at = max(at, end)
        if r.text is not None:
            assert safe[i].text == text + r.text[at:] and safe[i].n_chars == len(safe[i].text)
    assert safe.keys() == unlike.keys()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = {i: len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for i, r in safe.items()}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    ends = {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        assert p.start == ends.get(p.doc_id, 0) and p.doc_tokens == lengths[p.doc_id]
        ends[p.doc_id] = p.start + p.length
    assert ends == lengths
