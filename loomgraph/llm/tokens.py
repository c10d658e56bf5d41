"""Exact encoding by spans that the tokenizer treats on their own, with a bounded memory of spans met before.

Both kinds of vocabulary split text before merging, and never join what stands before a white-space run with what
follows it. So the ids of a text are those of its spans, one after the other, and a span is encoded only once.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Fixed: Unicode's white space. Python's \s holds \x1c to \x1f as well, so it isn't used.
SPACE = "\t-\r " + "".join(map(chr, (0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + chr(0x2000) + "-" + chr(0x200A)
_ATOMS = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
_WORDS = re.compile(f"[^{SPACE}]+")
_SPACES_THEN_BLANK = re.compile(f"[{SPACE}] ")
_PYTHON_ONLY = re.compile("[" + chr(0x1C) + "-" + chr(0x1F) + "]")
#: Characters from which on case or composition may depend on neighbours.
_CASE_BY_RULE = re.compile("[^" + chr(0) + "-" + chr(0x12F) + "]")
_GAP = re.compile(f"[{SPACE}]")
#: A comma or full stop at a span's end that no small letter stands before.
_OTHER_STOP = re.compile("[^a-z" + chr(0xDF) + "-" + chr(0xF6) + chr(0xF8) + "-" + chr(0x24F) + f"][,.](?:[{SPACE}]|" + r"\Z)")
#: Spans that a worker remembers: the first it meets, which are the frequent ones; others only while they are encoded.
#: Where that share of spans isn't among them, it forgets all and starts anew. Only speed depends on either.
MAX_SPANS, MOST_MISSED = 150_000, 0.3
#: Code points that are worked on at once.
SLICE = 1_500_000


class _Places(dict):
    """span -> place; a new one gets the next place and waits to be encoded."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, span: str) -> int:
        self[span] = place = len(self)
        self.fresh.append(span)
        return place


class SpanEncoder:
    """words: the vocabulary drops white space, so spans are words; else spans keep the white space before them."""

    def __init__(self, path: str, words: bool, most: int | None = None):
        from tokenizers import Tokenizer

        self.tokenizer, self.words, self.most = Tokenizer.from_file(path), words, most
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.marks = np.array([x.endswith("</w>") if words else x.startswith("\u0120") for x in names])
        self.forget()

    def forget(self) -> None:
        self.places = _Places()
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts, self.sizes, self.ends_sentence = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), np.zeros(1 << 14, bool)
        self.n_ids = 0
        self.kept: tuple[int, int] | None = None  # spans and ids that stay, once there are enough

    def _settle(self, met: int) -> None:
        """After each call: what goes beyond MAX_SPANS is dropped again."""
        if self.kept is None:
            if len(self.places) > (self.most or MAX_SPANS):
                self.kept = (len(self.places), self.n_ids)
            return
        spans, ids = self.kept
        if len(self.places) - spans > MOST_MISSED * met:
            self.forget()
            return
        while len(self.places) > spans:
            self.places.popitem()
        self.n_ids = ids

    def _store(self, places: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.places) > len(self.starts):
            self.starts, self.sizes, self.ends_sentence = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes, self.ends_sentence))
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.sizes[places] = sizes
        self.starts[places] = self.n_ids + np.cumsum(sizes) - sizes
        self.n_ids += len(ids)

    def _gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of spans, one after the other, and where each span's end."""
        sizes = self.sizes[places].astype(np.int64)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(self.starts[places] - (ends - sizes), sizes) + np.arange(total)], ends

    def _learn(self) -> None:
        fresh, self.places.fresh = self.places.fresh, []
        plain, made, places = [], [], self.places
        for span in fresh:
            # A letter and a comma or full stop after it are never merged: both are encoded apart.
            if span[-1] in ",." and len(span) > 1 and span[-2] < "\u0250" and span[-2].isalpha():
                made.append((places[span], places[span[:-1]], places[span[-1]]))
            else:
                plain.append(span)
        plain += self.places.fresh
        self.places.fresh = []
        alone = [x.isalpha() if self.words else x[0] == " " and x[1:].isalpha() for x in plain]
        self._learn_joined([x for x, a in zip(plain, alone, strict=True) if a])
        plain = [x for x, a in zip(plain, alone, strict=True) if not a]
        for at in range(0, len(plain), 4096):
            part = plain[at : at + 4096]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self._store(np.array([self.places[x] for x in part]), sizes, np.fromiter((i for ids in found for i in ids), np.uint32, int(sizes.sum())))
        for at in range(0, len(made), 65536):
            span, base, end = np.array(made[at : at + 65536]).T
            ids, _ = self._gather(np.stack([base, end], 1).ravel())
            self._store(span, self.sizes[base] + self.sizes[end], ids)
        known = np.fromiter(map(places.__getitem__, fresh), np.int64, len(fresh))
        self.ends_sentence[known] = [x[-1] in ".!?\u2026" for x in fresh]

    def _learn_joined(self, plain: list[str]) -> None:
        """Spans of letters alone: each is one piece to the vocabulary, so many are encoded as one text, and the mark
        that the vocabulary puts at a word's end (or begin, where spans keep a blank) tells them apart."""
        for at in range(0, len(plain), 8192):
            part = plain[at : at + 8192]
            ids = np.array(self.tokenizer.encode_batch_fast([(" " if self.words else "").join(part)], add_special_tokens=False)[0].ids, np.uint32)
            mark = np.flatnonzero(self.marks[ids])
            edges = np.concatenate([[0], mark + 1]) if self.words else np.concatenate([mark, [len(ids)]])
            if len(edges) != len(part) + 1 or edges[0] or edges[-1] != len(ids):
                found = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
                edges = np.concatenate([[0], np.cumsum(list(map(len, found)))]).astype(np.int64)
                ids = np.fromiter((i for x in found for i in x), np.uint32, int(edges[-1]))
            self._store(np.fromiter(map(self.places.__getitem__, part), np.int64, len(part)), np.diff(edges), ids)

    def spans(self, text: str) -> list[str]:
        if self.words:
            if not _CASE_BY_RULE.search(text):
                text = text.lower()  # the vocabulary does so itself; fewer spans differ
            if not _OTHER_STOP.search(text):
                # A letter and a comma or full stop after it are never merged: apart they are far fewer spans.
                text = text.replace(", ", " , ").replace(". ", " . ").replace(",\n", " ,\n").replace(".\n", " .\n")
                if text[-1:] in (",", "."):
                    text = text[:-1] + " " + text[-1]
            return _WORDS.findall(text) if _PYTHON_ONLY.search(text) else text.split()
        if _SPACES_THEN_BLANK.search(text) or text[:1] == " ":
            return _ATOMS.findall(text)
        first, *rest = text.split(" ")  # each blank follows another character, so spans begin at blanks
        out = [" " + x for x in rest]
        if first:
            out.insert(0, first)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """ids of all texts in one array; where each text's ids begin and end (one more than texts); where each
        span's ids end; where each text's spans begin and end."""
        lists = [self.spans(t) for t in texts]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        place = np.fromiter(map(self.places.__getitem__, chain.from_iterable(lists)), np.int64, int(counts.sum()))
        if self.places.fresh:
            self._learn()
        ids, ends = self._gather(place)
        span_at = np.concatenate([[0], np.cumsum(counts)])
        self.last_sentence_ends = self.ends_sentence[place]
        self._settle(len(place))
        return ids, np.concatenate([[0], ends])[span_at], ends, span_at


def encoder(path: str, words: bool, most: int | None = None) -> SpanEncoder:
    """One for each worker process, vocabulary and number of spans to remember."""
    store = _worker_store()
    if (path, words, most) not in store:
        store[path, words, most] = SpanEncoder(path, words, most)
    return store[path, words, most]


def let_go() -> None:
    """Forget this worker's encoders."""
    _worker_store().clear()


def _worker_store() -> dict:
    import sys
    import types

    return sys.modules.setdefault("_loomgraph_worker_store", types.ModuleType("_loomgraph_worker_store")).__dict__.setdefault("encoders", {})


def pieces(text: str, most: int = SLICE) -> Iterator[str]:
    """Very long texts come in parts that begin where white space follows another character."""
    while len(text) > most:
        at = most
        while (m := _GAP.search(text, at)) and _GAP.match(text, m.start() - 1):
            at = m.end()
        if not m:
            break
        yield text[: m.start()]
        text = text[m.start() :]
    yield text


def batches(rows, size=len, most: int = SLICE) -> Iterator[list]:
    """Rows in lists of about `most` code points."""
    held, total = [], 0
    for row in rows:
        n = size(row)
        if held and total + n > most:
            yield held
            held, total = [], 0
        held.append(row)
        total += n
    if held:
        yield held
