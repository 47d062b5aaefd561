import hashlib
import random
import re
import time

import numpy as np
import pytest

from tidegauge.llm import pii, tagger as tagging
from tidegauge.llm.tagger import Tagger, spans_of, tags_of

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def brute_base(text):
    """The contract's patterns, one after the other."""
    found = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == 2:
                doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
                if not 14 <= len(digits) <= 19 or sum(d - 9 * (d > 9) for d in doubled) % 10:
                    continue
            if kind == 3 and not 10 <= len(digits) <= 15:
                continue
            found.append((m.start(), kind, m.end()))
    return sorted(found)


def card(rng, n=16):
    while True:
        digits = "".join(rng.choice("0123456789") for _ in range(n))
        if pii.luhn(digits):
            return digits


def spans_in(rng):
    name = "".join(rng.choice("abcdefghij") for _ in range(6))
    return [
        f"{name}.{rng.randint(10, 99)}@mail{rng.randint(1, 9)}.example.com", ".".join(str(rng.randint(0, 255)) for _ in range(4)), card(rng),
        f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}",
    ]


@pytest.fixture(scope="module")
def private():
    """Documents, a third of them with one to four spans."""
    rng = random.Random(17)
    rows = []
    for i in range(600):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 60))]
        for span in rng.sample(spans_in(rng), rng.randint(1, 4)) if i % 3 == 0 else []:
            words.insert(rng.randrange(len(words)), span)
        rows.append((i, " ".join(words)))
    return rows


@pytest.fixture(scope="module")
def model(private):
    return pii.learnt([w for _, t in private for _, s in pii.stretches(t) for _, w in pii.windows_of(s)])


def test_patterns_match_the_definition(corpus, private):
    rng = random.Random(2)
    texts = [t for _, t in corpus + private]
    texts += ["".join(rng.choice("12.@+-( )a\n9é") for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += ["".join(rng.choice(["1", "25", "300", ".", "..", "@", "a.b", "+", " ", "-", "(5)"]) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    texts += ["x@a.b@c.d", "@a.b@c.d", "1.2.3.4.5.6.7.8", "00000255.1.1.1", "+1 2345678 90+1 2345678901", "４１１１111111111111"]
    for text in texts:
        assert pii.base_spans(text or "") == brute_base(text), text


def test_patterns_read_long_runs_a_bounded_number_of_times():
    started = time.monotonic()
    for text in ("1" * 300_000, "a" * 300_000, "a" * 300_000 + "@", "@a" * 100_000, "1.1." * 50_000 + "x", "+1 " * 100_000, "1 " * 150_000 + "a@b" * 50_000):
        pii.base_spans(text)
    assert time.monotonic() - started < 20


def test_stretches_hold_every_sign_with_what_is_around_it():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("abcdefgh " * 12 + "1@٣") for _ in range(rng.randint(0, 900)))
        parts = pii.stretches(text)
        covered = set()
        for (start, part), after in zip(parts, [*parts[1:], (10**9, "")]):
            assert text[start:start + len(part)] == part and start + len(part) <= after[0]
            windows = pii.windows_of(part)
            assert windows[-1][0] + len(windows[-1][1]) == len(part) and all(part[s:s + pii.WINDOW] == w for s, w in windows)
            covered |= set(range(start, start + len(part)))
        for i, c in enumerate(text):
            if c in "1@٣":
                assert set(range(max(0, i // 64 * 64 - 64 * (i >= 64)), min(len(text), i // 64 * 64 + 64))) <= covered


def test_gradients_are_those_of_the_loss():
    tagger = Tagger(7, 2, 3, 0)
    tagger.w = {k: v.astype(np.float64) for k, v in tagger.w.items()}
    rng = np.random.default_rng(0)
    chars = rng.integers(0, 7, (4, 6))
    tags = np.stack([tags_of(s, 6) for s in ([(1, 0, 4)], [], [(0, 1, 2), (2, 0, 3)], [(5, 1, 6)])])
    _, grads = tagger.loss(chars, tags)
    for name, w in tagger.w.items():
        for _ in range(4):
            i, old = tuple(rng.integers(0, s) for s in w.shape), 0.0
            old, w[i] = w[i], w[i] + 1e-4
            more = tagger.loss(chars, tags)[0]
            w[i] = old - 1e-4
            less = tagger.loss(chars, tags)[0]
            w[i] = old
            assert grads[name][i] == pytest.approx((more - less) / 2e-4, rel=1e-3, abs=1e-5), name


def test_best_tags_are_the_likeliest_of_all():
    from itertools import product

    tagger = Tagger(5, 1, 2, 1)
    chars = np.random.default_rng(1).integers(0, 5, (3, 4))
    best, sure = tagger.decode(chars)
    losses = {tags: [tagger.loss(chars[i:i + 1], np.array([tags]))[0] for i in range(3)] for tags in product(range(3), repeat=4)}
    for i in range(3):
        assert tuple(best[i]) == min(losses, key=lambda t: losses[t][i])
        chance = sum(np.exp(-v[i]) for t, v in losses.items() if t[2] == best[i][2])
        assert sure[i][2] == pytest.approx(chance, rel=1e-3) and sum(np.exp(-v[i]) for v in losses.values()) == pytest.approx(1, rel=1e-3)


def test_held_out_rewritten_spans_are_found(model):
    rng = random.Random(99)
    texts = []
    for i in range(300):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(14)]
        texts.append(" ".join(words[:7] + ([spans_in(rng)[i % 4]] if i % 5 else []) + words[7:])[:pii.WINDOW - 8])
    known = pii.examples(texts, 5)
    tags, sure = model.decode(pii.encoded([t for t, _ in known]))
    hit = want = wrong = 0
    for (text, spans), t, s in zip(known, tags, sure):
        found = {x[:3] for x in spans_of(t, s) if x[3] >= pii.CERTAIN}
        hit, want, wrong = hit + len(found & set(spans)), want + len(spans), wrong + sum(pii.plausible(k, text[a:b]) for a, k, b in found - set(spans))
    assert want > 300 and hit / want > 0.85 and wrong / want < 0.05


def test_parts_are_joined_and_the_surest_stays():
    text = "x" * 50 + "ana.lee (at) mail (dot) example (dot) com" + "x" * 50
    end = 50 + len("ana.lee (at) mail (dot) example (dot) com")
    parts = [(50, 0, 64, 0.9, True), (50, 0, end, 0.95, False), (64, 0, end, 0.8, True), (70, 3, 80, 0.99, False)]
    assert pii.reconciled(lambda a, b: text[a:b], parts, []) == [(50, 0, end)]
    # One that a pattern found stays; an added one may contain it, not cut it.
    assert pii.reconciled(lambda a, b: text[a:b], parts[1:2], [(50, 0, end)]) == []
    assert pii.reconciled(lambda a, b: text[a:b], parts[1:2], [(60, 0, 70)]) == [(50, 0, end)]
    assert pii.reconciled(lambda a, b: text[a:b], parts[1:2], [(40, 0, 60)]) == []
    assert not pii.plausible(2, "4111.1111.1111.1112") and pii.plausible(2, "4111.1111.1111.1111")
    assert not pii.plausible(3, "2024-01-30 12") and pii.plausible(3, "(017) 555-7713") and not pii.plausible(1, "300 . 1 . 1 . 1")


def test_spans_over_window_edges_are_found_wherever_they_stand(spark, model, stored):
    rng = random.Random(5)
    rows = []
    for i in range(128):
        words = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(90))
        text = words[:126 + i] + " " + spans_in(rng)[3].replace("+1 ", "") + " " + words[260:]
        rows.append((i, text))
    made = [(r.doc_id, r.spans) for r in pii.tagged(pii.screened(stored(rows)), model).collect()]
    whole = {i: f"phone:{t.index('(')}:{t.index('(') + 14}" for i, t in rows}
    assert sum(spans == whole[i] for i, spans in made) >= 0.9 * len(rows)


def test_result_of_all_documents(private, corpus, stored, empty):
    rows = private + [(10_000 + d, t) for d, t in corpus] + [(20_000, "é " * 70_000 + "eva@a.org 10.0.0.1"), (None, "me@b.co"), (None, None)] + private[:3]
    found = pii.personal_data(stored(rows)).collect()
    want = []
    for d, t in rows:
        base = brute_base(t)
        digest = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        want.append((d, *(sum(k == i for _, k, _ in base) for i in range(4)), hashlib.sha256(digest.encode()).hexdigest()))
    assert sorted((tuple(r)[:6] for r in found), key=repr) == sorted(want, key=repr)
    texts = dict(rows)
    for r in found:
        if r.doc_id is not None:
            spans = [s for s in r.spans.split(",") if s]
            base = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in brute_base(texts[r.doc_id])]
            assert set(base) <= set(spans) and len(spans) == len(base) + r.n_added
    clean = [r for r in found if r.doc_id is not None and not re.search("[0-9@]", texts[r.doc_id] or "")]
    assert clean and all(r.spans == "" for r in clean)
    assert pii.personal_data(empty).count() == 0


def test_tables_without_spans_and_with_other_columns(stored, odd):
    plain = stored([(1, "no data 5"), (2, None), (2, ""), (None, "x 1")])
    assert sorted((r.spans, r.n_added) for r in pii.personal_data(plain).collect()) == [("", 0)] * 4
    extra = stored([(1, "a@b.co", "s", 1, [2])], "doc_id int, text string, spans string, kinds int, texts array<int>")
    assert [tuple(r)[:5] for r in pii.personal_data(extra).collect()] == [(1, 1, 0, 0, 0)]
    assert pii.personal_data(odd).count() == odd.count()


def test_every_character_is_in_a_window_that_is_read():
    rng = random.Random(8)
    for n in (0, 1, 63, 64, 65, 1023, 1024, 1025, 1984, 1985, 5000):
        text = "".join(rng.choice("ab é漢😀\n") for _ in range(n))
        windows = pii.windows_to_read(text)
        assert [s for s, _ in windows] == [k * (pii.READ - pii.OVERLAP) for k in range(len(windows))]
        assert all((own == pii.numbers(text)[s:s + pii.READ]).all() and len(own) for s, own in windows)
        assert sum(len(own) for _, own in windows) == n + pii.OVERLAP * max(0, len(windows) - 1)
        assert not n or windows[-1][0] + len(windows[-1][1]) == n


def test_spans_without_digit_or_at_sign_are_found_wherever_they_stand(model, stored):
    rng = random.Random(6)
    rows, want, places = [], {}, ("start", "end", "middle")
    for i in range(120):
        words = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(500))
        span = "".join(rng.choice("abcdefghij") for _ in range(6)) + rng.choice((" (at) ", "[at]")) + "mail (dot) example (dot) com"
        before, after = ("", f" {words}") if i % 3 == 0 else (f"{words} ", "") if i % 3 == 1 else (f"{words[:890 + i]} ", f" {words[890 + i:]}")
        rows.append((i, before + span + after))
        want[i] = f"email:{len(before)}:{len(before) + len(span)}"
    assert not any(re.search("[0-9@]", t) for _, t in rows)
    made = {r.doc_id: r for r in pii.tagged(pii.screened(stored(rows)), model).collect()}
    found = {place: sum(made[i].spans == want[i] for i in want if i % 3 == k) for k, place in enumerate(places)}
    assert all(n >= 0.7 * 40 for n in found.values()), found
    assert all(made[i].n_email == 0 for i in want)


def test_examples_at_edges_keep_their_spans():
    rng = np.random.default_rng(1)
    text = "some words ana@a.org and 10.0.0.1 then more of them"
    spans = [(11, 0, 20), (25, 1, 33)]
    seen = set()
    for _ in range(40):
        new, moved = pii.at_edge(rng, text, spans)
        assert len(new) == pii.WINDOW and moved
        assert all(new[a:b] == ("ana@a.org", "10.0.0.1")[k] for a, k, b in moved)
        seen |= {(k, a == 0, b == len(new)) for a, k, b in moved if a == 0 or b == len(new)}
    assert seen == {(0, True, False), (0, False, True), (1, True, False), (1, False, True)}
    whole = "a@b.co " + "x" * 114 + " 1.1.1.1"[:7]
    assert all(len(pii.at_edge(rng, whole, [(0, 0, 6)])[0]) == pii.WINDOW for _ in range(9))


def test_windows_of_any_length_are_read_together_as_each_alone(model, private, monkeypatch):
    rng = random.Random(4)
    texts = ["", "x", "a@b"] + [(t * 3)[:rng.randint(1, 700)] for _, t in private[:60]]
    texts += [t.replace("@", " (at) ") for t in texts]
    windows = [pii.numbers(t) for t in texts]
    together = model.spans(windows)
    assert sum(map(len, together)) > 20
    assert [[x[:3] for x in s] for s in together] == [[x[:3] for x in model.spans([w])[0]] for w in windows]
    for w, spans in zip(windows, together):
        if len(w):
            tags, sure = model.decode(w[None].astype(np.int64))
            plain = spans_of(tags[0], sure[0])
            assert [x[:3] for x in plain] == [x[:3] for x in spans] and [x[3] for x in plain] == pytest.approx([x[3] for x in spans], abs=1e-4)
    # Steps between tags are left out only where they change nothing.
    monkeypatch.setattr(Tagger, "_outside", lambda self, leads, active: np.zeros(leads.shape[2], bool))
    assert [[x[:3] for x in s] for s in model.spans(windows)] == [[x[:3] for x in s] for s in together]


def test_windows_that_are_surely_outside_have_no_likelier_path():
    rng = np.random.default_rng(9)
    surely = 0
    for seed in range(300):
        tagger = Tagger(6, 2, 3, seed)
        tagger.w["step"], tagger.w["first"] = (rng.normal(0, 1.5, tagger.w[k].shape).astype(np.float32) for k in ("step", "first"))
        tagger.w["out_bias"][0] = rng.uniform(0, 6)
        lengths = np.sort(rng.integers(1, 9, 12))[::-1]
        active = np.array([(lengths > t).sum() for t in range(lengths[0])])
        leads = tagger._leads(rng.integers(0, 6, (lengths[0], 12)), active)
        outside = tagger._outside(leads, active)
        tags, _ = tagger._best(tagger._emissions(leads), active)
        surely += outside.sum()
        assert not (tags[outside] > 0).any()
    assert surely > 300


def test_windows_to_learn_from_are_of_both_sorts(private, stored, empty):
    docs = stored(private)
    windows = pii.sampled_windows(docs)
    every = {w for _, t in private for _, w in pii.windows_of(t)}
    signs = {w for _, t in private for _, s in pii.stretches(t) for _, w in pii.windows_of(s)}
    assert len(windows) == len(set(windows)) and set(windows) <= every | signs and signs <= set(windows)
    plain = [w for w in windows if not re.search("[0-9@]", w)]
    assert 250 < sum(w not in signs for w in plain) < 750
    few = pii.sampled_windows(docs, 100, 50)
    assert set(few) <= set(windows) and 50 < sum(w in signs for w in few) < 160 and 10 < sum(w not in signs for w in few) < 90
    assert pii.sampled_windows(empty) == []


def leads_with_tanh(tagger, chars):
    """`Tagger._leads` of windows of one length, each step with a tanh over all gates in rows of the windows."""
    w, size = tagger.w, tagger.hidden
    order = np.r_[1:tagger.n_tags:2, 2:tagger.n_tags:2]
    half = np.repeat(np.array([0.5, 0.5, 0.5, 1], w["state"].dtype), size)
    ones = np.tile(np.repeat(np.array([1, 1, 1, 0], half.dtype), size), (chars.shape[1], 1))
    found = 0
    for side in range(2):
        table, state = (w["input"][side] + w["bias"][side]) * half, w["state"][side] * half * 0.5
        out = w["out"][side * size:(side + 1) * size]
        out = np.ascontiguousarray((out[:, order] - out[:, :1]).T * 0.5)
        h, c, a = (np.zeros((chars.shape[1], size), half.dtype) for _ in range(3))
        z, x = np.empty_like(ones), np.empty_like(ones)
        made = np.empty((len(chars), len(out), chars.shape[1]), half.dtype)
        for t in range(len(chars)) if side == 0 else range(len(chars) - 1, -1, -1):
            np.take(table, chars[t], 0, out=x, mode="clip")
            np.matmul(h, state, out=z)
            z += x
            np.tanh(z, out=z)
            z += ones
            np.multiply(z[:, :size], z[:, 3 * size:], out=a)
            c *= z[:, size:2 * size]
            c += a
            c *= 0.5
            np.tanh(c, out=a)
            np.multiply(a, z[:, 2 * size:3 * size], out=h)
            np.matmul(out, h.T, out=made[t])
        found = found + made
    return found + (w["out_bias"][order] - w["out_bias"][0])[:, None]


def test_reading_costs_less_than_a_tanh_over_all_gates():
    tagger = Tagger(pii.CHARACTERS, len(pii.KINDS), pii.HIDDEN, 3)
    chars = np.random.default_rng(3).integers(0, pii.CHARACTERS, (60, 768))
    active = np.full(60, 768)
    assert np.allclose(tagger._leads(chars, active), leads_with_tanh(tagger, chars), atol=1e-4)
    costs = {tagger._leads: [], leads_with_tanh: []}
    for _ in range(9):
        for read, own in costs.items():
            started = time.thread_time()
            read(chars, active) if read != leads_with_tanh else read(tagger, chars)
            own.append(time.thread_time() - started)
    assert min(costs[tagger._leads]) < 0.88 * min(costs[leads_with_tanh])


@pytest.mark.parametrize("scale", [0.01, 1, 30, 1000])
@pytest.mark.filterwarnings("error")
def test_leads_are_those_of_the_emissions_that_are_learnt(scale):
    rng = np.random.default_rng(2)
    tagger = Tagger(9, 2, 6, 5)
    tagger.w["input"] *= scale
    tagger.w["out_bias"] = rng.normal(0, 1, tagger.n_tags).astype(np.float32)
    lengths = np.sort(rng.integers(1, 40, 25))[::-1]
    windows = [rng.integers(0, 9, n) for n in lengths]
    chars = np.zeros((lengths[0], 25), np.int64)
    for k, own in enumerate(windows):
        chars[:len(own), k] = own
    leads = tagger._leads(chars, np.array([(lengths > t).sum() for t in range(lengths[0])]))
    double = Tagger(9, 2, 6, 5)
    double.w = {k: v.astype(np.float64) for k, v in tagger.w.items()}
    for k, own in enumerate(windows):
        emissions = double._read(own[None])[0][0]
        want = (emissions - emissions[:, :1])[:, [1, 3, 2, 4]]
        assert np.allclose(leads[:len(own), :, k], want, atol=1e-4)


@pytest.mark.parametrize("cheap", [True, False])
@pytest.mark.parametrize("scale", [0.01, 1, 1000])
@pytest.mark.filterwarnings("error")
def test_leads_are_those_that_are_learnt_by_tanh_and_by_exp(monkeypatch, cheap, scale):
    monkeypatch.setattr(tagging, "tanh_is_cheap", lambda: cheap)
    rng = np.random.default_rng(12)
    tagger, double = Tagger(9, 3, 7, 5), Tagger(9, 3, 7, 5)
    tagger.w["input"] *= scale
    tagger.w["bias"] += rng.normal(0, 1, tagger.w["bias"].shape).astype(np.float32)
    double.w = {k: v.astype(np.float64) for k, v in tagger.w.items()}
    lengths = np.sort(rng.integers(1, 50, 23))[::-1]
    chars = rng.integers(0, 9, (lengths[0], 23))
    leads = tagger._leads(chars, np.array([(lengths > t).sum() for t in range(lengths[0])]))
    for k, n in enumerate(lengths):
        emissions = double._read(chars[:n, k][None])[0][0]
        want = (emissions - emissions[:, :1])[:, [1, 3, 5, 2, 4, 6]]
        assert np.allclose(leads[:n, :, k], want, atol=1e-4)


def test_steps_are_taken_the_cheaper_way(monkeypatch):
    tagger, own = Tagger(pii.CHARACTERS, len(pii.KINDS), pii.HIDDEN, 3), tagging.tanh_is_cheap()
    chars = np.random.default_rng(3).integers(0, pii.CHARACTERS, (60, 768))
    costs = {True: [], False: []}
    for _ in range(9):
        for cheap, took in costs.items():
            monkeypatch.setattr(tagging, "tanh_is_cheap", lambda: cheap)
            started = time.thread_time()
            tagger._leads(chars, np.full(60, 768))
            took.append(time.thread_time() - started)
    assert min(costs[own]) < 1.08 * min(costs[not own])
