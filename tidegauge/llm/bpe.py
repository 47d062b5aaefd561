"""Byte-pair encoding by speculation and verification, and decoding.

Greedy longest match proposes the tokens of all words of a batch at once. A
sequence is the exact encoding if each token encodes to itself and every two
neighbours stay apart when merged alone; all distinct pairs of neighbours are
tested together. Only words with a failing pair are merged step by step.

A null or empty text has no ids. Texts are encoded one by one, so ties and
repeated rows get equal results; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import map_arrow, query, table, text_of
from tidegauge.llm.tokens import WordMemory, public_path, ranges, tokenizer

VOCABULARY = "word_bpe_49k.json"
NEVER = np.int64(1) << 40
#: Symbols of a word are its bytes; the last byte of a word that ends is this much higher.
FINAL = 256
#: Texts encoded at a time in a task.
BATCH = 256


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a vocabulary file.

    Printable Latin-1 bytes stand for themselves, the others are numbered from U+0100.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(others)}}


class Table:
    """Values by distinct non-negative keys, looked up in bulk in an open-addressed table."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(4 * len(keys) + 1))))
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        place = self._place(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[place] < 0)
            won = free[np.unique(place[free], return_index=True)[1]]
            self.keys[place[won]], self.values[place[won]] = keys[won], values[won]
            rest = np.ones(len(keys), bool)
            rest[won] = False
            keys, values, place = keys[rest], values[rest], self._after(place[rest])

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _after(self, place: np.ndarray) -> np.ndarray:
        return (place + 1) & ((1 << self.bits) - 1)

    def find(self, keys: np.ndarray, missing: int) -> np.ndarray:
        place = self._place(keys)
        held = self.keys[place]
        hit = held == keys
        found = np.where(hit, self.values[place], missing)
        todo = np.flatnonzero(~hit & (held >= 0))
        place = self._after(place[todo])
        while len(todo):
            held = self.keys[place]
            hit = held == keys[todo]
            found[todo[hit]] = self.values[place[hit]]
            on = ~hit & (held >= 0)
            todo, place = todo[on], self._after(place[on])
        return found


class Vocabulary:
    """Tokens and merges of a file as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        model = held["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.tokens = [""] * (1 + max([*model["vocab"].values(), *(a["id"] for a in held["added_tokens"])]))
        for token, i in model["vocab"].items():
            self.tokens[i] = token
        self.special = {a["content"]: a["id"] for a in held["added_tokens"]}
        for token, i in self.special.items():
            self.tokens[i] = token
        letters = byte_letters()
        ends = len(self.suffix)

        def symbols(token: str) -> list[int]:
            last = ends and token.endswith(self.suffix)
            found = [letters[c] for c in (token[:-ends] if last else token)]
            return found[:-1] + [found[-1] + FINAL] if last else found

        n = len(self.tokens)
        self.rank = np.full(n, -1, np.int64)
        self.left, self.right = np.zeros(n, np.int64), np.zeros(n, np.int64)
        ids, pairs = model["vocab"], []
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            joined = (a[:-ends] if ends and a.endswith(self.suffix) else a) + b
            new = ids[joined]
            pairs.append((ids[a] << 20 | ids[b], rank, new))
            if self.rank[new] < 0:
                self.rank[new], self.left[new], self.right[new] = rank, ids[a], ids[b]
        keys, ranks, made = np.array(pairs, np.int64).reshape(-1, 3).T
        self.pairs = Table(keys, ranks)
        self.made_at = np.zeros(len(pairs), np.int64)
        self.made_at[ranks] = made
        self.base = np.zeros(2 * FINAL, np.int64)
        spelled = {}
        for token, i in ids.items():
            if token not in self.special:
                s = symbols(token)
                if len(s) == 1:
                    self.base[s[0]] = i
                spelled[i] = s
        own = self._encode_to_themselves()
        self._plant({i: s for i, s in spelled.items() if own[i]})
        self.known_keys, self.known = np.zeros(0, np.int64), np.zeros(0, bool)

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of two tokens, or NEVER."""
        return self.pairs.find(a << 20 | b, NEVER)

    def stay_apart(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Whether no merge joins the two sides of each boundary before rank ``limit``.

        The two tokens at the boundary are taken back in time, the later made one
        first. At each point they would merge if their pair comes before the merge
        that takes either of them away; on equal ranks the place further left goes first.
        """
        apart = np.ones(len(a), bool)
        todo = np.arange(len(a))
        x, y, x_goes, y_goes = a.copy(), b.copy(), limit.copy(), limit.copy()
        while len(todo):
            rank = self.pair_rank(x, y)
            joins = (rank < x_goes) & (rank <= y_goes) & (rank < NEVER)
            apart[todo[joins]] = False
            left_later = self.rank[x] > self.rank[y]
            go_on = ~joins & (np.maximum(self.rank[x], self.rank[y]) >= 0)
            x_goes, y_goes = np.where(left_later, self.rank[x], x_goes), np.where(left_later, y_goes, self.rank[y])
            x, y = np.where(left_later, self.right[x], x), np.where(left_later, y, self.left[y])
            todo, x, y, x_goes, y_goes = todo[go_on], x[go_on], y[go_on], x_goes[go_on], y_goes[go_on]
        return apart

    def _encode_to_themselves(self) -> np.ndarray:
        made = np.flatnonzero(self.rank >= 0)
        own = np.ones(len(self.rank), bool)
        own[made] = self.stay_apart(self.left[made], self.right[made], self.rank[made])
        while True:
            now = own.copy()
            now[made] &= own[self.left[made]] & own[self.right[made]]
            if (now == own).all():
                return own
            own = now

    def _plant(self, spelled: dict[int, list[int]]):
        """A trie of the tokens: sorted keys of node and symbol, next nodes, token per node."""
        nodes: dict[tuple[int, int], int] = {}
        token = [-1]
        for i, s in spelled.items():
            at = 0
            for symbol in s:
                step = (at, symbol)
                if step not in nodes:
                    nodes[step] = len(token)
                    token.append(-1)
                at = nodes[step]
            token[at] = i
        self.first = np.zeros(2 * FINAL, np.int64)
        for (node, symbol), to in nodes.items():
            if node == 0:
                self.first[symbol] = to
        steps = np.array([(node * 1024 + symbol, to) for (node, symbol), to in nodes.items()], np.int64)
        self.steps = Table(*steps.T)
        self.node_token = np.array(token, np.int64)

    def longest_matches(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``word, token`` of a greedy split of all words, walked side by side."""
        out_word, out_at, out_token = [], [], []
        word = np.flatnonzero(starts < ends)
        at = starts[word].copy()  # where the token of each word now starts
        while len(word):
            node = self.first[symbols[at]]
            best, upto = self.node_token[node], at + 1
            place, live = at + 1, np.flatnonzero(at + 1 < ends[word])
            while len(live):
                node_l = self.steps.find(node[live] * 1024 + symbols[place[live]], 0)
                ok = node_l > 0
                live, node_l = live[ok], node_l[ok]
                node[live] = node_l
                place[live] += 1
                token = self.node_token[node_l]
                hit = live[token >= 0]
                best[hit], upto[hit] = token[token >= 0], place[hit]
                live = live[place[live] < ends[word[live]]]
            out_word.append(word), out_at.append(at), out_token.append(best)
            on = upto < ends[word]
            word, at = word[on], upto[on]
        if not out_word:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        words, places, tokens = (np.concatenate(x) for x in (out_word, out_at, out_token))
        order = np.argsort(places, kind="stable")  # words are laid out one after the other
        return words[order], tokens[order]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair of neighbours stays apart; verdicts are remembered."""
        pairs, at = np.unique(a << 20 | b, return_inverse=True)
        new = pairs[~np.isin(pairs, self.known_keys, assume_unique=True)]
        if len(new):
            verdict = self.stay_apart(new >> 20, new & 0xFFFFF, np.full(len(new), NEVER))
            if len(self.known_keys) > 1_000_000:
                self.known_keys, self.known = np.zeros(0, np.int64), np.zeros(0, bool)
                return self.compatible(a, b)
            keys, values = np.concatenate([self.known_keys, new]), np.concatenate([self.known, verdict])
            order = np.argsort(keys)
            self.known_keys, self.known = keys[order], values[order]
        return self.known[np.searchsorted(self.known_keys, pairs)][at]

    def merged(self, tokens: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many words: in each the pairs of lowest rank, from the left, until none is left.

        ``tokens`` of all words one after the other, ``word`` says whose they are.
        """
        done_tokens, done_words = [], []
        while len(tokens):
            ranks = np.full(len(tokens), NEVER)
            inner = np.flatnonzero(word[1:] == word[:-1])
            ranks[inner] = self.pair_rank(tokens[inner], tokens[inner + 1])
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            sizes = np.diff(np.concatenate([first, [len(tokens)]]))
            lowest = np.repeat(np.minimum.reduceat(ranks, first), sizes)
            over = lowest == NEVER
            done_tokens.append(tokens[over]), done_words.append(word[over])
            hit = np.flatnonzero((ranks == lowest) & ~over)
            # In a row of overlapping pairs every second one merges.
            new = np.concatenate([[True], np.diff(hit) > 1])
            run = np.flatnonzero(new)[np.cumsum(new) - 1] if len(hit) else hit
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            stays = ~over
            tokens[hit] = self.made_at[ranks[hit]]
            stays[hit + 1] = False
            tokens, word = tokens[stays], word[stays]
        if not done_tokens:
            return tokens, word
        tokens, word = np.concatenate(done_tokens), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return tokens[order], word[order]

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Exact ids of words that have at least one byte: how many each has, and all of them."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        symbols = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        if self.suffix:
            symbols[ends - 1] += FINAL
        owner, tokens = self.longest_matches(symbols, ends - lengths, ends)
        inner = owner[1:] == owner[:-1]
        failed = np.zeros(len(words), bool)
        failed[owner[1:][inner][~self.compatible(tokens[:-1][inner], tokens[1:][inner])]] = True
        wrong = np.flatnonzero(failed)
        if len(wrong):
            right = ~failed[owner]
            places = ranges(ends[wrong] - lengths[wrong], lengths[wrong])
            again, whose = self.merged(self.base[symbols[places]], np.repeat(wrong, lengths[wrong]))
            owner, tokens = np.concatenate([owner[right], whose]), np.concatenate([tokens[right], again])
            order = np.argsort(owner, kind="stable")
            owner, tokens = owner[order], tokens[order]
        return np.bincount(owner, minlength=len(words)), tokens


#: Letters and numbers among the characters of `PLAIN`, and how each
#: vocabulary cuts a text into words.
LETTERS, NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼½¾"
WORDS = f"[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d|[{NUMBERS}]|[^\\s{LETTERS}{NUMBERS}]+"
SPACED = f" ?[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{NUMBERS}]+| ?[^\\s{LETTERS}{NUMBERS}]+|\\s+(?!\\S)|\\s+"
#: Texts of these characters have no normal form but lower case, and no special cases.
PLAIN = re.compile("[ -~\n¡-įı-ſ]*")


class Encoder:
    """Cuts texts into words and encodes words by a vocabulary file."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.path = path
        self.lowers = bool(self.vocabulary.suffix)
        self.cut = re.compile(WORDS if self.lowers else SPACED).findall
        self.marked = re.compile("(" + "|".join(map(re.escape, self.vocabulary.special)) + ")")
        self.letters = byte_letters()

    def split(self, text: str) -> list[str]:
        """Words in their normal form; special tokens are words of their own."""
        if "<|" in text:
            parts = self.marked.split(text)
            if len(parts) > 1:
                return [w for i, p in enumerate(parts) for w in ([p] if i % 2 else self.split(p))]
        if PLAIN.fullmatch(text):
            return self.cut(text.lower() if self.lowers else text)
        # Normal form and classes of all of Unicode, as the library's tables have them.
        made = tokenizer(self.path)
        if made.normalizer:
            text = made.normalizer.normalize_str(text)
        return [bytes(self.letters[c] for c in w).decode() for w, _ in made.pre_tokenizer.pre_tokenize_str(text)]

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        special = self.vocabulary.special
        ordinary = [i for i, w in enumerate(words) if w not in special]
        lengths, ids = self.vocabulary.words([words[i].encode() for i in ordinary])
        if len(ordinary) == len(words):
            return lengths, ids
        every = np.ones(len(words), np.int64)
        every[ordinary] = lengths
        marks = [i for i, w in enumerate(words) if w in special]
        # Each special token goes in after the ids of the ordinary words before it.
        before = np.cumsum(np.concatenate([[0], lengths]))[np.searchsorted(ordinary, marks)]
        return every, np.insert(ids, before, [special[words[i]] for i in marks])

    def decode(self, ids: np.ndarray) -> str:
        """Tokens with a space between: the file has no decoder of its own."""
        return " ".join(map(self.vocabulary.tokens.__getitem__, ids.tolist()))


class TextEncoder(WordMemory):
    def __init__(self, path: str):
        self.encoder = Encoder(path)
        super().__init__(self.encoder.split, self.encoder.encode)


@lru_cache(maxsize=4)
def text_encoder(path: str) -> TextEncoder:
    """One per worker and vocabulary."""
    return TextEncoder(path)


def coded_documents(docs: DataFrame, path: str, made, schema: str) -> DataFrame:
    """Rows of ``made(doc_id, ids, encoder)`` for every document, a batch at a time."""

    def rows(batch):
        coder = text_encoder(path)
        out = []
        for at in range(0, batch.num_rows, BATCH):
            part = batch.slice(at, BATCH)
            out += [made(d, ids, coder.encoder) for d, ids in zip(part.column(0).to_pylist(), coder.texts(part.column(1).to_pylist()))]
        names = [c.split()[0] for c in schema.split(", ")]
        return dict(zip(names, map(list, zip(*out)))) if out else None

    return map_arrow(docs.select(F.col("doc_id").cast("long"), text_of().alias("text")), rows, schema)


def round_trips(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document."""

    def made(doc_id, ids, encoder):
        data = ids.astype("<u4").tobytes()
        return doc_id, len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256(encoder.decode(ids).encode()).hexdigest()

    return coded_documents(docs, path, made, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


@query("op9_bpe_round_trip")
def op9(spark, sf_dir):
    return round_trips(table(spark, sf_dir, "documents"), public_path(VOCABULARY))
