"""BPE encoding and decoding by speculation and verification.

Greedy longest match over the vocabulary proposes the tokens of each new word.
A proposal is the exact BPE result if no merge would cross any boundary of
two adjacent tokens; numpy checks all distinct adjacent pairs at once. Only
words with a failing pair go through exact merging.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.llm.common import small_batches

WORD_END = "</w>"
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
# Fixed value: the split pattern of the vocabulary file's pre-tokenizer.
# It splits words of plain letters here; other texts go to the library's own
# normaliser and pre-tokenizer, whose Unicode tables may be of another version.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NEVER = np.int64(1 << 40)
CACHED = 300_000  # chunks a task remembers, and as many words
PLAIN = regex.compile(r"[\x00-\u024f]*+")
# Runs of these to a chunk's end, after a letter, are a word of their own.
TAIL = ".,;:!?#$%&*|)"
SHORT = 48  # symbols up to which exact merging scans instead of using a heap


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies use per byte."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    kept = set(keep)
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


class Codec:
    """Encoder of one word-end BPE vocabulary.

    Symbols are bytes 0..255, and 256 more for a byte that ends its word.
    """

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab = model["vocab"]
        self.code = code = {c: b for b, c in enumerate(byte_alphabet())}
        self.library = None
        self.front = {"version": "1.0", "added_tokens": [], "model": {"type": "BPE", "vocab": {}, "merges": []}}
        self.front |= {k: spec[k] for k in ("normalizer", "pre_tokenizer")}
        size = max(vocab.values()) + 1
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("|".join(regex.escape(s) for s in self.special)) if self.special else None
        self.words = regex.compile(WORDS)
        self.text = [""] * (max([size - 1, *self.special.values()]) + 1)
        for token, i in vocab.items():
            self.text[i] = token
        for token, i in self.special.items():
            self.text[i] = token

        self.rank = np.full(size, -1, np.int64)
        self.left = np.arange(size)
        self.right = np.arange(size)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        a = np.array([vocab[x] for x, _ in pairs])
        b = np.array([vocab[y] for _, y in pairs])
        made = np.array([vocab[x + y] for x, y in pairs])
        self.rank[made], self.left[made], self.right[made] = np.arange(len(pairs)), a, b
        key = a.astype(np.int64) << 32 | b
        order = np.argsort(key)
        self.pair_key, self.pair_rank, self.made_list = key[order], order.astype(np.int64), made.tolist()
        self.merge = dict(zip(key.tolist(), range(len(pairs))))

        symbols = {}
        self.base = np.full(512, -1, np.int64)
        for token, i in vocab.items():
            ends = token.endswith(WORD_END) and token != WORD_END
            s = [code[c] for c in (token[: -len(WORD_END)] if ends else token)]
            s[-1] += 256 * ends
            symbols[i] = s
            if len(s) == 1:
                self.base[s[0]] = i
        whole = self._reachable()
        self._trie({i: s for i, s in symbols.items() if whole[i]})

    def _reachable(self) -> np.ndarray:
        """Tokens that BPE makes of their own text."""
        merged = np.flatnonzero(self.rank >= 0)
        ok = np.ones(len(self.rank), bool)
        ok[merged] = self.compatible(self.left[merged], self.right[merged], self.rank[merged])
        while True:
            now = ok.copy()
            now[merged] &= ok[self.left[merged]] & ok[self.right[merged]]
            if (now == ok).all():
                return ok
            ok = now

    def _trie(self, symbols: dict[int, list[int]]) -> None:
        nodes: dict[int, int] = {}
        ends = {}
        for token, s in symbols.items():
            at = 0
            for x in s:
                at = nodes.setdefault(at * 512 + x, len(nodes) + 1)
            ends[at] = token
        keys = np.fromiter(nodes.keys(), np.int64, len(nodes))
        to = np.fromiter(nodes.values(), np.int64, len(nodes))
        order = np.argsort(keys)
        self.edge, self.to = keys[order], to[order]
        self.token_at = np.full(len(nodes) + 1, -1, np.int64)
        self.token_at[np.fromiter(ends.keys(), np.int64, len(ends))] = np.fromiter(ends.values(), np.int64, len(ends))

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, NEVER if there is none."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge crosses the boundary of tokens a and b.

        Goes back through the merges that made the two tokens, last first. At
        each point the tokens at the boundary would merge if their merge came
        before the next merge of either; at equal rank the left one is first.
        With ``before``, only merges ahead of that rank count.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        out = np.ones(len(a), bool)
        live = np.arange(len(a))
        next_a = np.full(len(a), NEVER) if before is None else before.astype(np.int64)
        next_b = next_a.copy()
        first = before is not None
        while len(live):
            r = self._pair(a, b)
            crossed = (r < next_a) & (r <= next_b) & (r < NEVER)
            if first:
                crossed[:] = False
            first = False
            out[live[crossed]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~crossed & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb, next_a, next_b = (x[go] for x in (live, a, b, ra, rb, next_a, next_b))
            undo_a = ra > rb
            next_a = np.where(undo_a, ra, next_a)
            next_b = np.where(undo_a, next_b, rb)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return out

    def propose(self, flat: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches: tokens and the word each belongs to, in
        order of word and place."""
        words, at = np.arange(len(begin)), begin.copy()
        got_word, got_token, got_at = [], [], []
        while len(words):
            node = np.zeros(len(words), np.int64)
            best = self.base[flat[at]]
            best_to = at + 1
            live, pos = np.arange(len(words)), at.copy()
            while len(live):
                key = node[live] * 512 + flat[pos]
                k = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
                found = self.edge[k] == key
                live, pos, k = live[found], pos[found] + 1, k[found]
                node[live] = self.to[k]
                token = self.token_at[self.to[k]]
                whole = token >= 0
                best[live[whole]], best_to[live[whole]] = token[whole], pos[whole]
                more = pos < end[words[live]]
                live, pos = live[more], pos[more]
            got_word.append(words)
            got_token.append(best)
            got_at.append(at)
            more = best_to < end[words]
            words, at = words[more], best_to[more]
        word, token = np.concatenate(got_word), np.concatenate(got_token)
        order = np.argsort(np.concatenate(got_at), kind="stable")
        return token[order], word[order]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Tokens of each (normalised, split, non-empty) word."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        end = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        begin = np.concatenate([[0], end[:-1]])
        flat[end - 1] += 256
        token, word = self.propose(flat, begin, end)
        inner = np.flatnonzero(word[1:] == word[:-1])
        key = token[inner] << 32 | token[inner + 1]
        distinct, back = np.unique(key, return_inverse=True)
        fine = self.compatible(distinct >> 32, distinct & 0xFFFFFFFF)[back]
        wrong = np.unique(word[inner[~fine]])
        first = np.searchsorted(word, np.arange(len(words) + 1))
        tokens = token.tolist()
        out = [tokens[i:j] for i, j in zip(first[:-1].tolist(), first[1:].tolist())]
        if len(wrong):
            single, at, to = self.base[flat].tolist(), begin.tolist(), end.tolist()
            for w in wrong.tolist():
                out[w] = self.merge_exactly(single[at[w] : to[w]])
        return out

    def merge_exactly(self, token: list[int]) -> list[int]:
        """Merges of lowest rank first, then leftmost. ``token``: one token a
        symbol. Short words scan for the least rank, long ones use a heap."""
        rank, made = self.merge.get, self.made_list
        if len(token) > SHORT:
            return self._merge_by_heap(token)
        never = len(made)
        ranks = [rank(a << 32 | b, never) for a, b in zip(token, token[1:])]
        while ranks:
            r = min(ranks)
            if r == never:
                break
            i = ranks.index(r)
            token[i] = made[r]
            del token[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(token[i - 1] << 32 | token[i], never)
            if i < len(ranks):
                ranks[i] = rank(token[i] << 32 | token[i + 1], never)
        return token

    def _merge_by_heap(self, token: list[int]) -> list[int]:
        n = len(token)
        after, prior = [*range(1, n), -1], [*range(-1, n - 1)]

        def rank(i: int, j: int) -> int | None:
            return self.merge.get(token[i] << 32 | token[j])

        heap = [(r, i, token[i], token[i + 1]) for i in range(n - 1) if (r := rank(i, i + 1)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if token[i] != a or j < 0 or token[j] != b:
                continue
            token[i], token[j] = self.made_list[r], -1
            after[i] = after[j]
            if after[j] >= 0:
                prior[after[j]] = i
            for x, y in ((prior[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := rank(x, y)) is not None:
                    heapq.heappush(heap, (r, x, token[x], token[y]))
        return [t for t in token if t >= 0]

    def split(self, chunk: str) -> list[str | int]:
        """Words of a chunk without white space; special tokens as ids."""
        out: list[str | int] = []
        at = 0
        for m in self.cut.finditer(chunk) if self.cut and "<|" in chunk else ():
            out += self._words(chunk[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self._words(chunk[at:])

    def _words(self, text: str) -> list[str]:
        if PLAIN.fullmatch(text):
            return self.words.findall(text.lower())
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(json.dumps(self.front))
        normal = self.library.normalizer.normalize_str(text)
        pieces = self.library.pre_tokenizer.pre_tokenize_str(normal)
        return [bytes(map(self.code.__getitem__, piece)).decode() for piece, _ in pieces]


def chunks(text: str) -> list[str]:
    """Text split at Unicode white space (str.split also splits at the four
    information separators, which are no white space in Unicode)."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return [c for c in regex.split(r"\p{White_Space}+", text) if c]
    return text.split()


class Memo:
    """Per chunk: its token ids and its decoded text, each joined by spaces.
    A chunk without white space always has a token."""

    def __init__(self, codec: Codec):
        self.codec = codec
        self.ids: dict[str, str] = {}
        self.decoded: dict[str, str] = {}
        self.tokens: dict[str, tuple[str, str]] = {}  # of words

    def _learn_words(self, words: set[str]) -> None:
        if len(self.tokens) + len(words) > CACHED:
            self.tokens = {w: t for w, t in self.tokens.items() if w in words}
        text = self.codec.text
        if fresh := [w for w in words if w not in self.tokens]:
            for w, ids in zip(fresh, self.codec.encode_words(fresh)):
                self.tokens[w] = " ".join(map(str, ids)), " ".join([text[i] for i in ids])

    def learn(self, wanted: set[str]) -> None:
        if len(self.ids) + len(wanted) > CACHED:
            self.ids = {c: k for c, k in self.ids.items() if c in wanted}
            self.decoded = {c: k for c, k in self.decoded.items() if c in wanted}
        words: set[str] = set()
        plain, others = [], []
        for chunk in wanted.difference(self.ids):
            # most are letters, or letters before a run of punctuation
            base = chunk.rstrip(TAIL)
            word = base.lower()
            if word.isalpha() and (word.isascii() or PLAIN.fullmatch(base)):
                tail = chunk[len(base) :]
                plain.append((chunk, word, tail))
                words.add(word)
                words.add(tail)
            else:
                parts = self.codec.split(chunk)
                others.append((chunk, parts))
                words.update([w for w in parts if isinstance(w, str)])
        words.discard("")
        self._learn_words(words)
        ids, decoded, tokens, text = self.ids, self.decoded, self.tokens, self.codec.text
        for chunk, word, tail in plain:
            if tail:
                (a, b), (c, d) = tokens[word], tokens[tail]
                ids[chunk], decoded[chunk] = f"{a} {c}", f"{b} {d}"
            else:
                ids[chunk], decoded[chunk] = tokens[word]
        for chunk, parts in others:
            both = [tokens[w] if isinstance(w, str) else (str(w), text[w]) for w in parts]
            ids[chunk] = " ".join([i for i, _ in both])
            decoded[chunk] = " ".join([d for _, d in both])

    def of(self, texts) -> Iterator[tuple[str, str]]:
        """Ids and decoded text of each text; null counts as empty. The new
        chunks of all texts are learned at once, so that numpy's calls are few."""
        own = [chunks(t) if t else [] for t in texts]
        self.learn(set().union(*own))
        for x in own:
            yield " ".join(map(self.ids.__getitem__, x)), " ".join(map(self.decoded.__getitem__, x))


def load_spec(path: str) -> dict:
    """The parts of a tokenizers file that encoding needs, read on the driver."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    kept = {k: spec[k] for k in ("added_tokens", "normalizer", "pre_tokenizer")}
    return kept | {"model": {k: spec["model"][k] for k in ("vocab", "merges")}}


def _shared_spec(docs: DataFrame, path: str):
    return docs.sparkSession.sparkContext.broadcast(json.dumps(load_spec(path)))


def encode(docs: DataFrame, path: str, text: str = "text", into: str = "bpe") -> DataFrame:
    """``docs`` with a struct column ``into`` (ids array<int>, decoded string).

    A null or blank text has no tokens and decodes to the empty text. Any
    other columns stay; a column named ``into`` is replaced. The vocabulary
    (a file of a few MB, fixed in size) is broadcast.
    """
    small_batches(docs.sparkSession)
    spec = _shared_spec(docs, path)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memo = Memo(Codec(json.loads(spec.value)))
        for texts in batches:
            both = list(memo.of(texts))
            yield pd.DataFrame({"ids": [np.fromstring(i, np.int32, sep=" ") for i, _ in both], "decoded": [d for _, d in both]})

    return docs.withColumn(into, F.pandas_udf(run, "ids array<int>, decoded string")(F.col(text)))


def decode(ids: Column, path: str, spark) -> Column:
    """Text of an id array: the tokens joined by one space, as the library
    does for a vocabulary file without a decoder; null ids are no ids."""
    spec = spark.sparkContext.broadcast(json.dumps(load_spec(path)))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        text = Codec(json.loads(spec.value)).text
        for each in batches:
            yield pd.Series(["" if x is None else " ".join([text[i] for i in x]) for x in each])

    return F.pandas_udf(run, "string")(ids)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row.

    The digests are of the same ids and decoded texts that ``encode`` gives;
    they are taken in the task, so that no ids travel.
    """
    small_batches(docs.sparkSession)
    spec = _shared_spec(docs, path)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memo = Memo(Codec(json.loads(spec.value)))
        for texts in batches:
            rows = []
            for ids, decoded in memo.of(texts):
                rows.append(
                    (
                        ids.count(" ") + 1 if ids else 0,
                        hashlib.sha256(ids.encode()).hexdigest(),
                        hashlib.sha256(decoded.encode()).hexdigest(),
                    )
                )
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", F.pandas_udf(run, kind)(F.col("text")).alias("d")).select("doc_id", "d.*")
