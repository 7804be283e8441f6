"""The pipeline stage by stage on a small fixture, and the registered names."""

from __future__ import annotations

import hashlib

import corpus_pipeline as p
from rankwell.llm import queries
from rankwell.llm.queries import vocabulary_path
from test_llm_operators import near_texts


def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    item = "which of these rivers runs through the old town of the north. the long grey river"
    texts = near_texts(groups=3, copies=4)
    texts.append(texts[0])
    words = "the house and garden with water are nice here".split()
    rows = [(i, t, "en", f"s{i % 2}", len(t), 1) for i, t in enumerate(texts)]
    rows += [(100, "123 456", "en", "s0", 7, 1), (101, None, "en", "s0", None, 1), (102, f"{' '.join(words * 3)} {item} {' '.join(words)}", "en", "s1", 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, extra int")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    left, kept = docs, []
    for name, stage in p.STAGES[:-1]:
        left = stage(spark, left, f"file://{tmp_path}")
        assert left.columns == docs.columns, name
        left = spark.createDataFrame(left.collect(), docs.schema)
        kept.append({r.doc_id for r in left.collect()})
    assert not kept[0] & {100, 101} and 102 in kept[2] and 102 not in kept[3]
    assert 12 in kept[1] and 12 not in kept[2] and 0 in kept[2] and kept[3] == kept[2] - {102}
    out = {r.doc_id: r for r in p.run(spark, f"file://{tmp_path}").collect()}
    assert set(out) == kept[3]
    lib = Tokenizer.from_file(vocabulary_path())
    for r in left.collect():
        ids = lib.encode(r.text, add_special_tokens=False).ids
        assert out[r.doc_id].n_tokens == len(ids)
        assert out[r.doc_id].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    empty = docs.limit(0)
    for _, stage in p.STAGES:
        empty = stage(spark, empty, f"file://{tmp_path}")
        assert empty.count() == 0


def test_names():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.queries()) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(queries.queries())
