import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from conftest import DOCUMENTS, words
from test_dedup import brute_components, brute_cut
from tidegauge.llm import packing, rules
from tidegauge.llm.tokens import public_path


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with junk, short texts, copies, near copies, shared passages, nulls and a long text."""
    rng = random.Random(21)
    passage = words(rng, 60)
    texts = [words(rng, rng.randint(60, 160)) for _ in range(80)]
    texts += [words(rng, 70) + "\n" + passage + "\n" + words(rng, 55) for _ in range(20)]
    for t in texts[:20]:
        copy = t.split(" ")
        copy[rng.randrange(len(copy))] = "changed"
        texts.append(" ".join(copy))
    texts += texts[30:40] * 3 + [texts[0]] * 30 + [words(rng, 6000), None, None, "", "few words"]
    junk = [" ".join(f"w{rng.randint(0, 999)}&&&" for _ in range(90)) for _ in range(30)]
    rows = list(enumerate(texts + junk))
    labels = [(d, 1) for d, t in rows[:100:2]] + [(d, 0) for d, _ in rows[-30::2]]
    path = tmp_path_factory.mktemp("corpus")
    shown = [(d, t, "en", "s", None if t is None else len(t)) for d, t in rows]
    spark.createDataFrame(shown, DOCUMENTS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows


def test_pipeline_matches_brute_force(spark, folder):
    path, rows = folder
    docs, labels = (spark.read.parquet(f"{path}/{name}.parquet") for name in ("documents", "labels"))
    good = {r.doc_id for r in rules.judge(docs, labels).where("kept").collect()}
    assert good and not good & {d for d, t in rows if len((t or "").split()) < 50 or "&" in t}
    last = {t: d for d, t in rows if d in good}
    kept = [(d, t) for d, t in rows if d in good and last[t] == d]
    assert len(kept) < len(good)
    least = {d: c for d, _, c in brute_components(kept, corpus_pipeline.SHINGLE, corpus_pipeline.MAX_DISTANCE)}
    kept = [(d, t) for d, t in kept if least[d] == d]
    assert len(kept) < len(least)
    cut = brute_cut([t.encode() for _, t in kept], 200)
    assert sum(n for _, n, _, _ in cut)
    library = Tokenizer.from_file(public_path(packing.VOCABULARY))
    want = {}
    for (d, _), (_, _, _, data) in zip(kept, cut):
        ids = np.array(library.encode(data.decode(), add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for k, length in enumerate(packing.cut_lengths(len(ids), 2048)):
            want[d, k] = (at, length, zlib.crc32(ids[at:at + length].tobytes()))
            at += length
    found = corpus_pipeline.run(spark, path).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in found} == want and len(found) == len(want)
    filled = defaultdict(int)
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled[r.sequence_id]
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 2048
    _, sequences = packing.best_fit(Counter(n for _, n, _ in want.values()), 2048)
    assert len(filled) == sequences


def test_pipeline_of_empty_tables(spark, folder, tmp_path):
    path, _ = folder
    for name in ("documents", "labels"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
