"""Token ids of whole texts from the tokenizers library, with a memo.

Byte-level BPE never joins text across a space that stands before a
non-space character, so a text is encoded chunk by chunk: Arrow lists the
distinct chunks of a batch and lays their ids out again. A worker process
remembers chunks from task to task. New chunks go to the library as one text;
the byte lengths of the returned tokens tell where each chunk ends.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast

CACHED = 750_000  # chunks in each of the two halves of a memo
TOGETHER = 200  # new chunks in a text for the library
BYTES = 4 << 20  # of the batches whose chunks are looked up together
# After a letter or digit, a run of these to the chunk's end is a piece of its own.
TAIL = ".,;:!?#$%&*|)"


class Encoder:
    """``special`` False makes the special tokens' strings ordinary text."""

    def __init__(self, spec: str, special: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        # the memo here replaces the library's word cache, whose memory a
        # worker process would keep for every tokenizer of every task
        model = self.tokenizer.model
        model._resize_cache(0)
        self.tokenizer.model = model
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = not special
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.size[i] = len(token)  # a character of a token stands for a byte
        self.known: dict[str, bytes] = {}  # chunks that follow a space, without it
        self.before: dict[str, bytes] = {}  # what was known when ``known`` was full
        self.tails: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in encoded]

    def _take_over(self, chunks: Iterable[str]) -> None:
        before = self.before
        if before:
            self.known.update([(c, before[c]) for c in chunks if c in before])

    def _learn(self, new: list[str]) -> None:
        """Puts the distinct chunks ``new``, none of them in ``known``, there. A
        full memo is set aside, and chunks met again are taken over from it."""
        known, before = self.known, self.before
        self._take_over(new)
        if before:
            new = [c for c in new if c not in known]
        cut = [(c, base) for c in new if (base := c.rstrip(TAIL)) != c and base and base[-1].isalnum()]
        bases = {b for _, b in cut if b not in known}
        self._take_over(bases)
        fresh = set(new).difference([c for c, _ in cut])
        fresh = list(fresh.union([b for b in bases if b not in known]))
        if fresh:
            texts = [" " + " ".join(fresh[at : at + TOGETHER]) for at in range(0, len(fresh), TOGETHER)]
            raw = b"".join(self._ids(texts))
            ends = np.cumsum(self.size[np.frombuffer(raw, "<u4")])
            # a chunk ends where the next one's space begins
            spaces = np.flatnonzero(np.frombuffer("".join(texts).encode(), np.uint8) == 32)
            stops = 4 * (np.searchsorted(ends, np.append(spaces[1:], ends[-1])) + 1)
            starts = np.append(0, stops[:-1])
            known.update(zip(fresh, map(raw.__getitem__, map(slice, starts.tolist(), stops.tolist()))))
        if cut:
            unseen = list({c[len(b) :] for c, b in cut}.difference(self.tails))
            self.tails.update(zip(unseen, self._ids(unseen)))
            for c, base in cut:
                known[c] = known[base] + self.tails[c[len(base) :]]

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        texts = [t or "" for t in texts]
        if not texts:
            return []
        parts = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        starts = parts.offsets.to_numpy()
        # the first chunk has no space before it, so it is encoded on its own
        later = np.ones(starts[-1], bool)
        later[starts[:-1]] = False
        coded = pc.filter(parts.values, pa.array(later)).dictionary_encode()
        chunks, places = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices
        bounds = starts - np.arange(len(starts))  # of the texts in places
        if len(self.known) + len(chunks) > CACHED:
            self.known, self.before = {}, self.known
        ids = list(map(self.known.get, chunks))
        new = [k for k, x in enumerate(ids) if x is None]
        # a space that the chunk rule does not cover: such texts are encoded in whole
        odd = [k for k in new if not chunks[k] or chunks[k][0].isspace()]
        whole = np.zeros(len(texts), bool)
        if odd:
            hit = np.flatnonzero(np.isin(places.to_numpy(), odd))
            whole[np.searchsorted(bounds, hit, "right") - 1] = True
            for k in odd:
                ids[k] = b""
            new = [k for k in new if ids[k] is None]
        self._learn([chunks[k] for k in new])
        for k in new:
            ids[k] = self.known[chunks[k]]
        laid = pa.array(ids, pa.large_binary()).take(places)
        _, at, data = laid.buffers()
        data = memoryview(data or b"")
        at = np.frombuffer(at, np.int64, len(laid) + 1, 8 * laid.offset)[bounds].tolist()
        whole = whole.tolist()
        alone = self._ids([t if w else t.split(" ", 1)[0] for t, w in zip(texts, whole)])
        return [x if w else x + data[a:b] for x, w, a, b in zip(alone, whole, at[:-1], at[1:])]


def shared_encoder(spec: Broadcast, special: bool = True) -> Encoder:
    """The encoder of this worker process for a broadcast ``{"spec": text}``:
    kept in the broadcast's value, which stays as long as tasks of the same
    job follow each other in the process and goes with the broadcast."""
    held = spec.value
    if special not in held:
        held[special] = Encoder(held["spec"], special)
    return held[special]


def encoded(encoder: Encoder, batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Each batch with the ids of its ``text``s. Small batches are encoded
    together, as more of their chunks are the same then."""

    def done(group: list[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
        ids = iter(encoder.encode([t for b in group for t in b.column("text").to_pylist()]))
        for b in group:
            yield b, list(islice(ids, b.num_rows))

    group, size = [], 0
    for batch in batches:
        group.append(batch)
        size += batch.nbytes
        if size >= BYTES:
            yield from done(group)
            group, size = [], 0
    if group:
        yield from done(group)


def read_spec(path: str) -> str:
    """A tokenizers file, read on the driver."""
    with open(path, encoding="utf-8") as f:
        return f.read()
