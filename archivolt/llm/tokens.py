"""Token ids of whole texts by a public tokenizer whose pre-tokens never cross ASCII white space."""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from archivolt.llm.shared import coded_words, give_back

END = 1  # the id that ends a document
MARKS = '!"#$%&()*+,-./:;<=>?@[]^_`{|}~'  # of ASCII's marks, those that no contraction begins with


class Encoder:
    """Encodes distinct words once and gathers their ids; a bounded number of them is kept for the life of a Python
    worker.

    The result equals encoding the whole text: the tokenizer drops white space, its normaliser and pre-tokenizer
    look at nothing beyond it, and its special tokens hold none.  Words of letters are one pre-token each, so they go
    through a tokenizer of the same vocabulary without those steps, many in one call; the marks that end its words
    tell them apart.  All other words take the tokenizer as it is."""

    held: dict[str, Encoder] = {}

    def __init__(self, path: str, most: int = 450_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            plan = json.load(file)
        end = plan["model"]["end_of_word_suffix"]
        vocabulary = plan["model"]["vocab"]
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith(end)]] = True
        plan["normalizer"] = None
        plan["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
        plan["added_tokens"] = []
        self.letters = Tokenizer.from_str(json.dumps(plan))
        self.most = most
        self._fresh()
        del plan, vocabulary
        give_back()

    def _fresh(self) -> None:
        """slot 0 is the empty word, slot 1 the end of a document; pool holds the ids of all slots."""
        self.slots = {"": 0}
        self.begin, self.size, self.pool = np.array([0, 0]), np.array([0, 1]), np.array([END], np.uint32)

    @classmethod
    def at(cls, path: str) -> Encoder:
        if path not in cls.held:
            cls.held[path] = cls(path)
        return cls.held[path]

    def _add(self, words: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        first = len(self.size)
        self.slots.update(zip(words, range(first, first + len(words)), strict=True))
        self.begin = np.concatenate([self.begin, len(self.pool) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.pool = np.concatenate([self.pool, ids])

    def _learn(self, need: list[str]) -> None:
        """Slots of runs of letters and of marks; -1 for any other, whose words are encoded whole."""
        plain, other = [], []
        for w in need:
            if w.isalpha() and (w.isascii() or w.lower().isalpha() and unicodedata.is_normalized("NFC", w)):
                (plain if w == w.lower() else other).append(w)
            elif not w.strip(MARKS):
                other.append(w)
            else:
                self.slots[w] = -1
        for at in range(0, len(plain), 20_000):
            some = plain[at : at + 20_000]
            ids = np.array(self.letters.encode(" ".join(some), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.ends_word[ids])
            if len(ends) == len(some):
                self._add(some, np.diff(ends, prepend=-1), ids)
            else:
                other += some
        self._whole(other)

    def _whole(self, words: list[str]) -> None:
        if words:
            lists = [x.ids for x in self.whole.encode_batch(words, add_special_tokens=False)]
            self._add(words, np.fromiter(map(len, lists), np.int64, len(lists)), np.array([i for x in lists for i in x], np.uint32))

    def _slots(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Two slots for each word: its letters and the marks that end it, or the whole word and nothing.  ASCII case
        folds alike anywhere, and runs of letters and of marks are pre-tokens of their own."""
        core = pc.ascii_rtrim(words, characters=MARKS)
        marked = np.flatnonzero((pc.binary_length(words).to_numpy() != pc.binary_length(core).to_numpy()))
        core = pc.ascii_lower(core).dictionary_encode()
        cores, tails = core.dictionary.to_pylist(), np.zeros(len(words), np.int64)
        ends = [w[len(w.rstrip(MARKS)) :] for w in words.take(pa.array(marked)).to_pylist()]
        need = [w for w in {*cores, *ends} if w not in self.slots]
        if len(self.slots) + len(need) > self.most:
            self._fresh()
            need = [w for w in {*cores, *ends} if w]
        if need:
            self._learn(need)
        get = self.slots.__getitem__
        one = np.fromiter(map(get, cores), np.int64, len(cores))[core.indices.to_numpy(zero_copy_only=False)] if len(cores) else tails
        tails[marked] = np.fromiter(map(get, ends), np.int64, len(ends))
        odd = np.flatnonzero(one < 0)
        if len(odd):
            odd_words = words.take(pa.array(odd)).to_pylist()  # kept under a name that no run of letters or marks has
            known = {w: k for w in odd_words if (k := self.slots.get(f"\n{w}")) is not None}
            fresh = [w for w in odd_words if w not in known]
            if fresh:
                first = len(self.size)
                self._whole([f"\n{w}" for w in fresh])
                known.update(zip(fresh, range(first, first + len(fresh)), strict=True))
            one[odd] = [known[w] for w in odd_words]
            tails[odd] = 0
        return one, tails

    def _ids(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of slots behind one another, and the size of each."""
        n = self.size[slots]
        source = np.repeat(self.begin[slots] - (np.cumsum(n) - n), n)
        source += np.arange(len(source))
        return self.pool[source], n

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts behind one another (each ended by END), and where each text begins, with the end."""
        words, index, offsets = coded_words(texts)
        one, two = self._slots(words)
        # the ids of each distinct word once, then those of all words, with the end mark after each text
        flat, n = self._ids(np.append(np.stack([one, two], axis=1).ravel(), 1))
        size = np.append(n[:-1].reshape(-1, 2).sum(axis=1), 1)
        begin = np.cumsum(size) - size
        at = np.insert(index, offsets[1:], len(words))
        bounds = offsets + np.arange(len(offsets))
        n = size[at]
        ends = np.cumsum(n)
        source = np.repeat(begin[at] - (ends - n), n)
        source += np.arange(len(source))
        return flat[source], np.concatenate([[0], ends])[bounds]
