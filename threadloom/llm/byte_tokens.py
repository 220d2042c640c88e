"""Ids of byte-level BPE vocabularies for whole Arrow columns: words are cut in bulk, each distinct word is encoded once."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

#: Classes of characters in the pattern that byte-level vocabularies split by.
LETTER, NUMBER, SPACE, OTHER, UNKNOWN = 1, 2, 3, 4, 0
#: Code points whose words are cut at once; longer words, in bytes, go to the library; the rank of a pair that doesn't merge.
BLOCK, LONG, NONE = 6_000_000, 64, np.int32(2**31 - 1)


class ByteTokenizer:
    """The ids that the tokenizers library gives for byte-level BPE files that split by the usual pattern (contractions, words
    with one leading space, runs of digits, of other characters, of white space). A file with anything else is encoded by the
    library text by text, and so is any text that holds one of the file's added tokens."""

    def __init__(self, file: str):
        import json

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(file)
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [x["content"] for x in spec.get("added_tokens") or []]
        pre = spec.get("pre_tokenizer") or {}
        self.plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        self.classes = np.zeros(0x110000, np.uint8)
        self.plain = self.plain and self._merges(spec["model"])

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and where each text's begin (one more at the end). Null counts as empty."""
        strings = [x or "" for x in texts.to_pylist()]
        slow = [i for i, s in enumerate(strings) if not self.plain or any(a in s for a in self.added)]
        own = dict(zip(slow, self.library.encode_batch([strings[i] for i in slow], add_special_tokens=False), strict=True))
        parts, counts = [], np.zeros(len(strings), np.int64)
        block: list[int] = []
        size = 0
        for i in range(len(strings) + 1):
            if block and (i == len(strings) or i in own or size >= BLOCK):
                got, n = self._block([strings[j] for j in block])
                parts.append(got)
                counts[block] = n
                block, size = [], 0
            if i < len(strings):
                if i in own:
                    parts.append(np.array(own[i].ids, np.uint32))
                    counts[i] = len(own[i].ids)
                else:
                    block.append(i)
                    size += len(strings[i])
        starts = np.concatenate([[0], np.cumsum(counts)])
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), starts

    def _block(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        chars = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32)
        lengths = np.array([len(s) for s in strings], np.int64)
        begins = np.concatenate([[0], np.cumsum(lengths)])
        if not len(chars):
            return np.zeros(0, np.uint32), np.zeros(len(strings), np.int64)
        starts = np.flatnonzero(self.word_starts(chars, begins[:-1]))
        data = "".join(strings).encode("utf-8")
        offsets = starts if len(data) == len(chars) else np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)[starts]
        offsets = np.append(offsets, len(data)).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        coded, first, count = self._coded(words.dictionary)
        which = words.indices.to_numpy()
        n = count[which]
        ends = np.cumsum(n)
        at = np.repeat((first[which] - (ends - n)).astype(np.int32), n)
        at += np.arange(ends[-1], dtype=np.int32)
        ids = coded[at]
        word_of = np.searchsorted(starts, begins)  # every text's first word
        upto = np.concatenate([[0], ends])
        return ids, np.diff(upto[word_of])

    def _coded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all words, where each word's are, and how many. Every round merges, in every word, its pair of the least
        rank; a merge makes pairs of higher ranks only, so that this is what merging one pair at a time gives."""
        offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        size = np.diff(offsets)
        word = np.repeat(np.arange(len(words), dtype=np.int32), size)
        done_word, done_id = [], []
        long = np.flatnonzero(size > LONG)
        if len(long):
            for k, e in zip(long.tolist(), self.library.encode_batch([words[k].as_py().decode("utf-8") for k in long.tolist()], add_special_tokens=False), strict=True):
                done_word.append(np.full(len(e.ids), k, np.int32))
                done_id.append(np.array(e.ids, np.int32))
            short = ~(size > LONG)[word]
            data, word = data[short], word[short]
        token = self.of_byte[data]
        rank = self.of_bytes[data[:-1].astype(np.int32) << 8 | data[1:]] if len(word) else np.zeros(0, np.int32)
        rank = np.append(rank, NONE)[: len(word)]
        rank[np.flatnonzero(word[1:] != word[:-1])] = NONE
        while len(word):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lows = np.minimum.reduceat(rank, starts)
            least = np.repeat(lows, np.diff(np.append(starts, len(word))))
            over = least == NONE
            at = np.flatnonzero((rank == least) & ~over)
            keep = ~over
            done_word.append(word[over])
            done_id.append(token[over])
            keep[at + 1] = False
            double = np.flatnonzero(at[1:] - at[:-1] == 1) + 1  # x x x: every other pair
            if len(double):
                run = np.arange(len(at))
                own = np.append(True, at[1:] - at[:-1] != 1)
                run -= np.maximum.accumulate(np.where(own, run, 0))
                keep[at[run % 2 == 1] + 1] = True
                at = at[run % 2 == 0]
                keep[at + 1] = False
            token[at] = self.merged[rank[at]]
            new = np.zeros(len(word), bool)
            new[at] = True
            word, token, rank, new = word[keep], token[keep], rank[keep], new[keep]
            at = np.flatnonzero(new)
            before = at[at > 0] - 1
            for x in (at, before):
                y = np.minimum(x + 1, len(word) - 1)
                beside = (word[y] == word[x]) & (y > x)
                rank[x] = np.where(beside, self._ranks(token[x], token[y]), NONE)
        word = np.concatenate([np.zeros(0, np.int32), *done_word])
        order = np.argsort(word, kind="stable")
        count = np.bincount(word, minlength=len(words)).astype(np.int64)
        return np.concatenate([np.zeros(0, np.int32), *done_id])[order].view(np.uint32), np.cumsum(count) - count, count

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        at = self._slots(keys)
        found = self.pairs[at]
        rank = np.where(found == keys, self.pair_ranks[at], NONE)
        on = np.flatnonzero((found != keys) & (found >= 0))  # the next slots may have it
        at = at[on]
        while len(on):
            at = at + 1 & len(self.pairs) - 1
            found = self.pairs[at]
            hit = found == keys[on]
            rank[on[hit]] = self.pair_ranks[at[hit]]
            more = ~hit & (found >= 0)
            on, at = on[more], at[more]
        return rank

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _merges(self, model: dict) -> bool:
        """Tables of the file's merges; False if the file has anything that they can't express."""
        vocab = model.get("vocab")
        if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")):
            return False
        cut = self.library.pre_tokenizer.pre_tokenize_str
        sign: dict[int, str] = {}  # the character that stands for a byte
        for c in (*range(0x80), *(0x80 + 64 * i for i in range(30)), *range(0x80, 0xC0), 0x800, *(0x1000 * i for i in range(1, 16)), *(0x40000 * i for i in range(1, 5)), 0x10000):
            for byte, s in zip(chr(c).encode(), "".join(x for x, _ in cut(chr(c))), strict=True):
                sign[byte] = s
        if any(s not in vocab for s in sign.values()):
            return False
        self.of_byte = np.array([vocab[sign[b]] if b in sign else 0 for b in range(256)], np.int32)  # other bytes aren't in UTF-8
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], np.int64).reshape(-1, 3)
        keys = ids[:, 0] << 32 | ids[:, 1]
        if not len(keys) or len(np.unique(keys)) < len(keys):
            return False
        self.merged = ids[:, 2].astype(np.int32)
        self.bits = len(keys).bit_length() + 3
        self.pairs, self.pair_ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        for rank, (at, key) in enumerate(zip(self._slots(keys).tolist(), keys.tolist(), strict=True)):
            while self.pairs[at] >= 0:
                at = at + 1 & len(self.pairs) - 1
            self.pairs[at], self.pair_ranks[at] = key, rank
        self.of_bytes = self._ranks(np.repeat(self.of_byte, 256), np.tile(self.of_byte, 256))
        return True

    def word_starts(self, chars: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where words start in chars, the code points of texts that begin at begins."""
        kind = self._kinds(chars)
        starts = np.zeros(len(chars) + 1, bool)
        first = np.zeros(len(chars) + 1, bool)
        first[begins] = True  # an empty text at the end begins behind the last character
        first = first[:-1]
        before = np.concatenate([[0], kind[:-1]])
        before[first] = 0
        blank = np.concatenate([[False], chars[:-1] == 0x20]) & ~first
        starts[:-1] = kind != before
        after_space = (before == SPACE) & (kind != SPACE)
        starts[:-1][np.flatnonzero(after_space) - 1] = True  # the last of a run of white space stands alone or leads the word
        starts[:-1] &= ~(after_space & blank)
        self._contractions(chars, starts, (chars == 0x27) & (before != OTHER) & ~blank, first)
        starts[:-1] |= first
        return starts[:-1]

    @staticmethod
    def _contractions(chars: np.ndarray, starts: np.ndarray, quotes: np.ndarray, first: np.ndarray) -> None:
        at = np.flatnonzero(quotes)
        here = lambda i: np.where((at + i < len(chars)), chars[np.minimum(at + i, len(chars) - 1)], 0)
        new = lambda i: np.where((at + i < len(chars)), first[np.minimum(at + i, len(chars) - 1)], True)
        one, two = here(1), here(2)
        short = np.isin(one, [ord(x) for x in "stmd"]) & ~new(1)
        long = ((one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))) & ~new(1) & ~new(2)
        starts[at[short | long] + 1] = False
        starts[at[short] + 2] = True
        starts[at[long] + 3] = True

    def _kinds(self, chars: np.ndarray) -> np.ndarray:
        kind = self.classes[chars]
        if not kind.all():
            cut = self.library.pre_tokenizer.pre_tokenize_str
            for c in np.unique(chars[kind == UNKNOWN]):
                beside = lambda x, c=chr(c): len(cut(x + c)) == 1  # noqa: E731  one word with a character of the class
                self.classes[c] = LETTER if beside("a") else NUMBER if beside("1") else OTHER if beside("!") else SPACE
            kind = self.classes[chars]
        return kind
