"""Personal data: patterns, and a character-level LSTM with a CRF for what they miss.

The patterns find addresses, numbers of networks, cards and phones as they are usually
written; they hold wherever they match. The tagger reads windows of characters and finds
the same kinds in other dress: letters beyond ASCII, ``name (at) host [dot] org``, other
separators, no plus sign. It learns from labelled spans: windows of the corpus with the
spans that the patterns find there, and the same windows with those spans rewritten in
ways that the patterns don't cover, or with numbers in their place that are no personal
data. About `FIT_WINDOWS` different windows with a digit or an at sign are taken, as only
they can hold a labelled span, and about `FIT_PLAIN` others, by hash cutoffs that follow
from their numbers; the model is small and goes to all tasks.

1. Every whole text is searched by the patterns, and read by the tagger from its first
   character to its last: in windows of up to `READ` characters, each of which begins
   `OVERLAP` characters before the one before ends.
2. Windows are decoded. All spans of a document are then reconciled together: parts of
   one kind that overlap where a window ends are joined, each is checked against what
   its kind must look like in the whole text, and of overlapping ones the surest stays.
   A span that a pattern found stays as it is; a found one that overlaps it is added only
   if it contains it as a whole.

A null text is an empty one and has no spans. Very long texts are windows like others;
a pattern looks at a character a bounded number of times. Repeated rows and null ids give
a row each. Without any labelled span nothing is learnt and only the patterns count. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import lru_cache
from itertools import groupby
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import map_arrow, query, table, text_of
from tidegauge.llm.tagger import Tagger, tags_of
from tidegauge.session import materialise

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: Characters of a window to learn from, and from one to the next.
WINDOW, STRIDE = 128, 64
#: Characters of a window that is read, and of two neighbours in common: as many as those above have.
READ, OVERLAP = 1024, WINDOW - STRIDE
#: About so many different windows are learnt from, with a sign and without.
FIT_WINDOWS, FIT_PLAIN = 1500, 500
#: So many of the examples with spans are learnt once more with one at an edge.
AT_EDGE = 0.35
#: A span is added if each of its characters is at least so likely.
CERTAIN = 0.7
HIDDEN, STEPS, BATCH, RATE, SEED = 20, 600, 48, 0.02, 7

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
# Runs of digits are begun at their first one only, so a failing run is read once.
NETWORK = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PLUS = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SIGN = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    odd = sum(int(d) for d in digits[-1::-2])
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _only_digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def emails(text: str) -> list[tuple[int, int, int]]:
    """Leftmost matches, from each at sign to both sides: the name may begin where the last match ended."""
    found, done, before = [], 0, 0
    for m in DOMAIN.finditer(text):
        # Characters of a name in front of the sign, none of them read twice for two signs.
        at = m.start()
        start = at
        while start > max(done, before) and not NOT_LOCAL.match(text, start - 1, start):
            start -= 1
        if start < at:
            found.append((start, EMAIL, m.end()))
            done = m.end()
        before = at + 1
    return found


def shapes(text: str) -> list[tuple[int, int, int]]:
    """What looks like a span of its kind: ``start, kind, end``."""
    found = emails(text) if "@" in text else []
    found += [(m.start(), IP, m.end()) for m in NETWORK.finditer(text)]
    found += [(m.start(), CARD, m.end()) for m in DIGITS.finditer(text) if 14 <= len(_only_digits(m[0])) <= 19]
    if "+" in text:
        found += [(m.start(), PHONE, m.end()) for m in PLUS.finditer(text) if 10 <= len(_only_digits(m[0])) <= 15]
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """The patterns' spans in the order of the result."""
    if not SIGN.search(text):
        return []
    kept = []
    for start, kind, end in shapes(text):
        if kind == IP and not all(map(_small, text[start:end].split("."))):
            continue
        if kind == CARD and not luhn(_only_digits(text[start:end])):
            continue
        kept.append((start, kind, end))
    return sorted(kept)


def shown(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


# -- windows -------------------------------------------------------------------------


CHARACTERS = 103  # 0 is no character, the last are beyond the basic plane


@lru_cache(maxsize=1)
def _numbers() -> np.ndarray:
    """Number of each character of the basic plane: its own if ASCII, else that of its class; then that of all others."""
    def number(code: int) -> int:
        c = chr(code)
        if " " <= c <= "~":
            return code - 31
        if c == "\N{FULLWIDTH COMMERCIAL AT}":
            return ord("@") - 31
        return 96 + (0 if c.isspace() else 1 if c.isdecimal() else 2 if c.islower() else 3 if c.isupper() else 4 if c.isalpha() else 5)

    return np.array([*map(number, range(65536)), CHARACTERS - 1], np.uint8)


def numbers(text: str) -> np.ndarray:
    return _numbers()[np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), 65536)]


def encoded(texts: list[str]) -> np.ndarray:
    """A row of character numbers per window."""
    out = np.zeros((len(texts), WINDOW), np.int64)
    for row, text in zip(out, texts):
        row[:len(text)] = numbers(text)
    return out


def windows_to_read(text: str) -> list[tuple[int, np.ndarray]]:
    """Windows that hold every character of a text, as character numbers; neighbours overlap, the last reaches the end."""
    own = numbers(text)
    return [(s, own[s:s + READ]) for s in range(0, max(1, len(own) - OVERLAP), READ - OVERLAP)] if len(own) else []


# -- windows to learn from -----------------------------------------------------------


def _is_sign(c: str) -> bool:
    return c in "@＠" or c.isdecimal()


def stretches(text: str) -> list[tuple[int, str]]:
    """``start, text`` of the windows to learn from with a digit or an at sign, those that touch as one."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    sign = _signs()[np.minimum(codes, 65535)] & (codes < 65536)
    cells = np.unique(np.flatnonzero(sign) // STRIDE)
    # A window begins at each cell of its signs and at the cell before.
    begin = np.unique(np.concatenate([cells, np.maximum(cells - 1, 0)]))
    out = []
    for _, run in groupby(enumerate(begin.tolist()), lambda p: p[1] - p[0]):
        run = [cell for _, cell in run]
        if out and run[0] * STRIDE < out[-1][1]:  # overlaps the last
            out[-1][1] = run[-1] * STRIDE + WINDOW
        else:
            out.append([run[0] * STRIDE, run[-1] * STRIDE + WINDOW])
    return [(start, text[start:end]) for start, end in out]


@lru_cache(maxsize=1)
def _signs() -> np.ndarray:
    return np.array([_is_sign(chr(code)) for code in range(65536)])


def windows_of(stretch: str) -> list[tuple[int, str]]:
    """Windows of a stretch; the last reaches its end."""
    starts = range(0, max(1, len(stretch) - STRIDE), STRIDE)
    return [(s, stretch[s:s + WINDOW]) for s in starts]


# -- labelled spans ------------------------------------------------------------------

# Ways to write the signs of addresses and numbers, and letters beside ASCII.
AT = ("@", " @ ", "(at)", " (at) ", "[at]", " [at] ", "＠")
DOT = (".", ".", " . ", "(dot)", " (dot) ", "[dot]", " [dot] ")
BETWEEN_PARTS = (" . ", "[.]", "(.)", " .")
BETWEEN_GROUPS = (".", "/", "_", "\u00a0", "  ", " - ")
BETWEEN_PHONE = (" ", "-", ".", "/", "\u00a0")
LETTERS = {"a": "äáàâã", "e": "éèêë", "i": "íìîï", "o": "öóòôõ", "u": "üúùû", "n": "ñ", "c": "ç", "s": "ßš"}


def _random_digits(rng: np.random.Generator, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def rewritten(rng: np.random.Generator, kind: int, span: str) -> str:
    """The span in a dress that the patterns don't know, with other digits."""
    pick = lambda values: values[rng.integers(len(values))]
    if kind == EMAIL:
        name, _, host = span.partition("@")
        if rng.random() < 0.4:
            name = "".join(pick(LETTERS[c]) if c in LETTERS and rng.random() < 0.5 else c for c in name)
            return f"{name}@{host}"
        return name + pick(AT) + pick(DOT).join(host.split("."))
    if kind == IP:
        return pick(BETWEEN_PARTS).join(str(rng.integers(1, 256)) for _ in range(4))
    if kind == CARD:
        return pick(BETWEEN_GROUPS).join(_random_digits(rng, 4) for _ in range(4))
    between, parts = pick(BETWEEN_PHONE), [_random_digits(rng, n) for n in (3, 3, 4)]
    if rng.random() < 0.5:
        parts[0] = f"({parts[0]})"
    else:
        parts[0] = "0" + parts[0]
    return pick(("", "", "00" + _random_digits(rng, 2) + between)) + between.join(parts)


def harmless(rng: np.random.Generator) -> str:
    """A number that is no personal data."""
    day, month, year = rng.integers(1, 29), rng.integers(1, 13), rng.integers(1900, 2030)
    made = (
        f"{year}-{month:02d}-{day:02d}", f"{day:02d}.{month:02d}.{year}", f"{rng.integers(24):02d}:{rng.integers(60):02d}:{rng.integers(60):02d}",
        f"{rng.integers(1, 999)},{_random_digits(rng, 3)}.{_random_digits(rng, 2)}", f"v{rng.integers(9)}.{rng.integers(20)}.{rng.integers(20)}",
        rng.bytes(int(rng.integers(6, 21))).hex(), _random_digits(rng, int(rng.integers(1, 13))), f"{rng.integers(100)}%", f"@{_random_digits(rng, 2)}",
        f"{_random_digits(rng, 3)}-{_random_digits(rng, 1)}-{_random_digits(rng, 2)}-{_random_digits(rng, 6)}-{_random_digits(rng, 1)}", f"{year}/{month:02d}/{day:02d} {rng.integers(24):02d}:{rng.integers(60):02d}",
    )
    return made[rng.integers(len(made))]


def labelled(text: str) -> list[tuple[int, int, int]] | None:
    """Spans of a window, none overlapping another; None where one may go on beyond its edge."""
    if _is_sign(text[0]) or _is_sign(text[-1]):
        return None
    kept, done = [], 0
    for start, kind, end in sorted(shapes(text), key=lambda s: (s[0], -s[2])):
        if start >= done:
            if start == 0 or end == len(text):
                return None
            kept.append((start, kind, end))
            done = end
    return kept


def at_edge(rng: np.random.Generator, text: str, spans: list[tuple[int, int, int]]) -> tuple[str, list[tuple[int, int, int]]]:
    """A window with one of its spans at its start or end, as at those of a text; filled up with what is around its spans."""
    start, _, end = spans[rng.integers(len(spans))]
    around = f"{text[spans[-1][2]:]} {text[:spans[0][0]]} "
    around *= -(-WINDOW // len(around))
    if rng.random() < 0.5:
        return f"{text[start:]} {around}"[:WINDOW], [(a - start, k, b - start) for a, k, b in spans if a >= start]
    before = f"{around} "[end - WINDOW:] if end < WINDOW else ""
    return before + text[:end], [(a + len(before), k, b + len(before)) for a, k, b in spans if b <= end]


def examples(texts: list[str], seed: int = SEED) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Windows with spans as they are, and again with their spans rewritten or put out of the way; some with a span at an edge.

    Windows of texts with a span at their edge are not taken, as it may go on there.
    """
    rng = np.random.default_rng(seed)
    out = []
    for text in texts:
        spans = labelled(text) if text else None
        if spans is None:
            continue
        out.append((text, spans))
        for again in range(2 if spans else 1):
            new, moved, done = "", [], 0
            for start, kind, end in spans:
                new += text[done:start]
                if rng.random() < (0.8 if again == 0 else 0.5):
                    put = rewritten(rng, kind, text[start:end])
                    moved.append((len(new), kind, len(new) + len(put)))
                else:
                    put = harmless(rng)
                new, done = new + put, end
            new += text[done:]
            if not spans:
                at = [m.start() for m in re.finditer(" ", text)] or [len(text)]
                place = at[rng.integers(len(at))]
                new = f"{text[:place]} {harmless(rng)}{text[place:]}"
            if moved and moved[-1][2] > WINDOW:
                continue
            out.append((new[:WINDOW], moved))
    edges = np.random.default_rng(seed + 1)
    return out + [at_edge(edges, *known) for known in out if known[1] and edges.random() < AT_EDGE]


def learnt(texts: list[str]) -> Tagger | None:
    """A tagger of the labelled spans in these windows; None if there is no span."""
    known = examples(sorted(texts))
    if not any(spans for _, spans in known):
        return None
    model = Tagger(CHARACTERS, len(KINDS), HIDDEN, SEED)
    model.fit(encoded([t for t, _ in known]), np.stack([tags_of(s, WINDOW) for _, s in known]), STEPS, BATCH, RATE, SEED)
    return model


# -- spans of a document -------------------------------------------------------------

#: Within a line.
SPACES = r"[^\S\r\n]*"


def plain(text: str) -> str:
    """Compatible characters as one, signs as they are usually written."""
    text = unicodedata.normalize("NFKC", text)
    text = re.sub(rf"{SPACES}[(\[{{]{SPACES}at{SPACES}[)\]}}]{SPACES}|{SPACES}@{SPACES}", "@", text, flags=re.I)
    return re.sub(rf"{SPACES}[(\[{{]{SPACES}(?:dot|\.){SPACES}[)\]}}]{SPACES}|{SPACES}\.{SPACES}", ".", text, flags=re.I)


def plausible(kind: int, text: str) -> bool:
    """Whether a span is what its kind must be, however it is written."""
    text = plain(text)
    if kind == EMAIL:
        return re.fullmatch(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)+", text) is not None
    if kind == IP:
        parts = text.split(".")
        return len(parts) == 4 and all(re.fullmatch("[0-9]{1,3}", p) and _small(p) for p in parts)
    digits = _only_digits(text)
    if kind == CARD:
        return re.fullmatch(r"[0-9](?:[ ./_-]{0,3}[0-9])+", text) is not None and 14 <= len(digits) <= 19 and luhn(digits)
    # A phone number without a plus sign has an area code in brackets or begins with a zero, and is written in groups.
    return re.fullmatch(r"[+(0][ ()./0-9-]*[0-9]", text) is not None and 10 <= len(digits) <= 15 and re.search(r"[0-9)][ ./-]+[0-9]", text) is not None


def reconciled(text_at, found: list[tuple[int, int, int, float, bool]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans to add, from those of all windows: ``start, kind, end, confidence, cut``.

    ``text_at(start, end)`` gives the text; ``cut`` says that a span ends where its window does.
    """
    joined: list[list] = []
    for start, kind, end, sure, cut in sorted(found, key=lambda s: (s[1], s[0], s[2])):
        last = joined[-1] if joined else None
        if last and last[1] == kind and start <= last[2] and (cut or last[4] or (start, end) == (last[0], last[2])):
            # A span at the edge of its window goes on in the next one; the same span in both is as sure as the surer.
            same = (start, end) == (last[0], last[2])
            last[2], last[3], last[4] = max(last[2], end), max(last[3], sure) if same else min(last[3], sure), last[4] and cut
        else:
            joined.append([start, kind, end, sure, cut])
    taken: list[tuple[int, int, int]] = []
    for start, kind, end, sure, _ in sorted(joined, key=lambda s: (-s[3], s[0], s[2], s[1])):
        if sure < CERTAIN or not plausible(kind, text_at(start, end)) or (start, kind, end) in base:
            continue
        if any(a < end and start < b and not (k == kind and start <= a and b <= end) for a, k, b in base):
            continue
        if all(b <= start or end <= a for a, _, b in taken):
            taken.append((start, kind, end))
    return sorted(taken)


def screened(docs: DataFrame) -> DataFrame:
    """``doc_id, text``, and ``starts, kinds, ends`` of the patterns' spans."""

    def rows(batch):
        spans = [base_spans(text) for text in batch.column(1).to_pylist()]
        out = {"doc_id": batch.column(0), "text": batch.column(1)}
        return out | {name: [[s[i] for s in own] for own in spans] for i, name in enumerate(("starts", "kinds", "ends"))}

    schema = "doc_id long, text string, starts array<int>, kinds array<int>, ends array<int>"
    return map_arrow(docs.select(F.col("doc_id").cast("long"), text_of().alias("text")), rows, schema)


def sampled_windows(docs: DataFrame, most: int = FIT_WINDOWS, plain: int = FIT_PLAIN) -> list[str]:
    """Of the different windows about ``most`` with a sign and ``plain`` without, by cutoffs of their hashes."""
    texts = docs.select(text_of().alias("text"))
    # A window without a sign is known by the cutoff, before any is moved: most windows are such.
    number = texts.select(F.sum(F.greatest(F.lit(1), F.ceil((F.length("text") - STRIDE) / STRIDE))).alias("n")).first().n or 0
    below = int(2**32 * min(1, plain / max(1, number)))

    def rows(batch):
        made, signs = [], []
        for text in batch.column(0).to_pylist():
            with_sign = [w for _, part in stretches(text) for _, w in windows_of(part)] if text else []
            others = [w for _, w in windows_of(text) if crc32(w.encode()) < below and not any(map(_is_sign, w))] if text else []
            made += with_sign + others
            signs += [True] * len(with_sign) + [False] * len(others)
        return {"text": made, "sign": signs}

    there = materialise(map_arrow(texts, rows, "text string, sign boolean").distinct(), "windows")
    n = there.where("sign").count()
    # Of up to twice as many windows all are near the cutoff; the rest follows the law of large numbers.
    cutoff = (2**63 - 1) if n <= most else int((2 * most / n - 1) * 2**63)
    return [r.text for r in there.where(~F.col("sign") | (F.xxhash64("text") <= cutoff)).collect()]


def tagged(rows: DataFrame, model: Tagger | None) -> DataFrame:
    """One row per document with all its spans."""
    names = ("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added")

    def added(texts: list[str], bases: list) -> list[list[tuple[int, int, int]]]:
        if model is None:
            return [[] for _ in texts]
        windows, places = [], []
        for doc, text in enumerate(texts):
            for at, own in windows_to_read(text):
                windows.append(own)
                places.append((doc, at, len(text)))
        found: list[list] = [[] for _ in texts]
        for (doc, at, length), own, spans in zip(places, windows, model.spans(windows)):
            for start, kind, end, chance in spans:
                cut = (start == 0 and at > 0) or (end == len(own) and at + end < length)
                found[doc].append((at + start, kind, at + end, chance, cut))
        return [reconciled(lambda a, b, text=text: text[a:b], spans, base) for text, spans, base in zip(texts, found, bases)]

    def run(batch):
        own = batch.to_pydict()
        bases = [list(zip(*x)) for x in zip(own["starts"], own["kinds"], own["ends"])]
        made = []
        for doc_id, base, more in zip(own["doc_id"], bases, added(own["text"], bases)):
            counts = [sum(kind == k for _, kind, _ in base) for k in range(len(KINDS))]
            made.append((doc_id, *counts, hashlib.sha256(shown(base).encode()).hexdigest(), shown(base + more), len(more)))
        return dict(zip(names, zip(*made)))

    schema = f"doc_id long, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string, n_added long"
    return map_arrow(rows, lambda batch: run(batch) if batch.num_rows else None, schema)


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: spans by the patterns, their number by kind and digest, and all spans."""
    return tagged(screened(docs), learnt(sampled_windows(docs)))


@query("op11_personal_data")
def op11(spark, sf_dir):
    return personal_data(table(spark, sf_dir, "documents"))
