import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidegauge.llm import bpe, packing, token_files
from tidegauge.llm.tokens import public_path

PIECES = [
    "a", "the", "'s", "don't", " ", "  ", "\n", "\n\n", " \n", "\t", "\u00a0", "é", "e\u0301", "<|endoftext|>", "12", "&&&", "\x1c", "\u2003",
    "Σ", "ΑΣ", "İ", "ǅ", "\u0301", "foo", " bar", "\r\n", "가", "ŉ", "²", "<|", "a" * 70, "ab" * 40, "!" * 90, "ingthe", "\U0001f600",
]


@pytest.fixture(scope="module", params=["byte_bpe_50k.json", "word_bpe_49k.json"])
def vocabulary(request):
    path = public_path(request.param)
    return path, Tokenizer.from_file(path), bpe.text_encoder(path)


def test_texts_are_encoded_as_the_library_does(vocabulary, corpus):
    _, library, own = vocabulary
    rng = random.Random(2)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    texts += ["".join(rng.choice("abcdeiou nrst") for _ in range(rng.randint(0, 200))) for _ in range(1000)] + [t or "" for _, t in corpus]
    for text, ids, want in zip(texts, own.texts(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert ids.tolist() == want.ids, text


def test_neighbours_that_fail_are_merged_exactly(vocabulary):
    _, library, own = vocabulary
    held = own.encoder.vocabulary
    rng = random.Random(4)
    words = [("".join(rng.choice("aeinorst") for _ in range(rng.randint(1, 14)))).encode() for _ in range(3000)]
    lengths, ids = held.words(words)
    parts = np.split(ids, np.cumsum(lengths)[:-1])
    assert all(p.tolist() == library.encode(w.decode(), add_special_tokens=False).ids for p, w in zip(parts, words))


def test_round_trips(documents, corpus):
    path = public_path(bpe.VOCABULARY)
    library = Tokenizer.from_file(path)
    want = []
    for d, t in corpus:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(tuple, bpe.round_trips(documents, path).collect())) == want


@pytest.mark.parametrize("size", [2, 3, 257, 49_408, 65_537])
def test_packed_bits_come_back(size):
    bits = token_files.bits_for(size)
    assert size <= 1 << bits < 2 * size
    ids = np.random.default_rng(size).integers(0, size, 1001).astype(np.uint32)
    data = token_files.pack_bits(ids, bits)
    assert len(data) == -(-1001 * bits // 8)
    assert (token_files.unpack_bits(data, bits, 1001) == ids).all()


def test_files_give_random_access(tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 100)
    rng = np.random.default_rng(1)
    ids = [rng.integers(0, 49_408, n).astype(np.uint32) for n in (0, 1, 99, 100, 101, 950, 7)]
    token_files.write_file(str(tmp_path / "f"), [None, 1, 2, 3, 4, 5, -6], ids, 16)
    file = token_files.TokenFile(str(tmp_path / "f"))
    flat = np.concatenate(ids)
    for a, b in ((0, 0), (0, 1), (99, 101), (100, 200), (350, 1258), (1258, 1258)):
        assert (file.ids(a, b) == flat[a:b]).all()
    found = list(file.documents())
    assert [d for d, _, _ in found] == [None, 1, 2, 3, 4, 5, -6] and all((x == y).all() for (_, _, x), y in zip(found, ids))


def test_written_tokens_are_in_order(documents, corpus, monkeypatch):
    path = public_path(token_files.VOCABULARY)
    library = Tokenizer.from_file(path)
    files = token_files.write_tokens(documents, path)
    want, at = [], 0
    for d, t in corpus:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, token_files.read_tokens(files).collect())) == want


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for x in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= x]
        gaps.append((min(fits) if fits else capacity) - x)
        if fits:
            gaps.remove(min(fits))
    return len(gaps)


@pytest.mark.parametrize("seed", range(30))
def test_matches_are_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 2048])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 400))]
    matches, sequences = packing.best_fit(Counter(lengths), capacity)
    assert sequences == best_fit_decreasing(lengths, capacity)


def test_packed_documents_are_gapless(documents, corpus):
    library = Tokenizer.from_file(public_path(packing.VOCABULARY))
    rows = packing.packed_documents(documents).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for d, t in corpus:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        own = sorted(by_doc[d], key=lambda r: r.piece)
        assert [r.length for r in own] == packing.cut_lengths(len(ids), 2048)
        assert [r.ids_crc32 for r in own] == [zlib.crc32(ids[r.start:r.start + r.length].tobytes()) for r in own]
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(by_sequence) == best_fit_decreasing([r.length for r in rows], 2048)


def test_odd_tables(odd, empty):
    n = odd.count()
    path = public_path(bpe.VOCABULARY)
    assert bpe.round_trips(odd, path).count() == n
    files = token_files.write_tokens(odd, path)
    read = sorted(token_files.read_tokens(files).collect(), key=lambda r: r.start)
    assert len(read) == n and [r.doc_id for r in read][:2] == [None, None]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(read, read[1:]))
    assert packing.packed_documents(odd).where("piece = 0").count() == n
    for rows in (bpe.round_trips(empty, path), token_files.read_tokens(token_files.write_tokens(empty, path)), packing.packed_documents(empty)):
        assert rows.count() == 0
