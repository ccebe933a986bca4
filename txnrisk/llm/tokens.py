"""Token ids of many texts with a public tokenizer, each distinct word worked out once per worker."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Vocabulary used where the caller names none; a path may be given instead.
VOCABULARY = "word_bpe_49k.json"
#: Characters of pieces that a worker remembers, and as many of pieces used before those. With its ids, a
#: piece takes some 25 bytes a character, so a worker holds about 100 MB.
REMEMBERED = 2_000_000
#: Longer words are encoded each time they are met.
LONGEST = 64
#: Characters of text handled at a time.
AT_ONCE = 1_000_000
ID = np.dtype("<u4")

#: Fixed value: the pattern by which the vocabulary's own tokenizer cuts a text into pieces.
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: What of it is not a run of letters, for Arrow's expressions.
_BETWEEN = r"'(?:s|t|re|ve|m|ll|d)|\pN|[^\t\n\v\f\r \pL\pN]+"
#: Outside of these characters, lower case, normal form or white space may depend on more than the character.
_ODD = re.compile("[^\t\n\v\f\r\x20-\x7e\xa1-\xac\xae-\u012f\u0131-\u024f]")


def vocabulary(path: str | None = None) -> str:
    import public_tokenizers

    return path or public_tokenizers.path(VOCABULARY)


class Encoder:
    """Gives the same ids as the tokenizer's encode(text, add_special_tokens=False).

    A tokenizer that cuts texts into pieces by a pattern gives every piece its ids independently of the pieces
    around it. Texts are put in lower case and cut, and their pieces numbered, by Arrow, so that Python
    looks at each distinct piece of a megabyte once: in a bounded memory, or by encoding it. Texts
    with characters beyond Latin letters are cut at white space of ASCII only, and their words encoded as they
    are. Other tokenizers encode whole texts.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.remembered = remembered
        self.words, self.pieces = _Memory(remembered // 3), _Memory(remembered)
        parts = json.loads(self.tokenizer.to_str())
        model, cut, norm = parts["model"], parts.get("pre_tokenizer") or {}, parts.get("normalizer") or {}
        steps = [x["type"] for x in norm.get("normalizers", [])]
        cuts = cut.get("pretokenizers", [{}])
        suffix = model.get("end_of_word_suffix")
        self.by_piece = bool(suffix) and steps == ["NFC", "Replace", "Lowercase"] and (
            cuts[0].get("type") == "Split" and cuts[0].get("behavior") == "Removed" and cuts[0].get("invert")
            and cuts[0]["pattern"].get("Regex") == PATTERN)
        if self.by_piece:
            self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
            for token, i in self.tokenizer.get_vocab().items():
                self.last[i] = token.endswith(suffix)
            self.marked = [x["content"] for x in parts.get("added_tokens", [])]

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; none for a null text."""
        if not self.by_piece:
            for text in texts:
                ids = self.tokenizer.encode(text or "", add_special_tokens=False).ids
                yield np.asarray(ids, ID).tobytes()
            return
        held: list[str] = []
        chars = 0
        for text in texts:
            held.append(text or "")
            chars += len(held[-1])
            if chars >= AT_ONCE:
                yield from self._joined(held)
                held, chars = [], 0
        yield from self._joined(held)

    def _joined(self, texts: list[str]) -> list[bytes]:
        odd = [bool(_ODD.search(text)) or any(x in text for x in self.marked) for text in texts]
        plain = iter(self._looked_up([t for t, o in zip(texts, odd) if not o], True))
        other = iter(self._looked_up([t for t, o in zip(texts, odd) if o], False))
        return [next(other if o else plain) for o in odd]

    def _looked_up(self, texts: list[str], latin: bool) -> list[bytes]:
        if not texts:
            return []
        held = pa.array(texts, pa.large_string())
        if latin:
            held = pc.replace_substring_regex(pc.utf8_lower(held), _BETWEEN, r" \0 ")
        cut = pc.ascii_split_whitespace(held)
        ends = cut.offsets.to_numpy()
        numbered = cut.values.dictionary_encode()
        each = self._ids(numbered.dictionary.to_pylist(), latin)
        at = numbered.indices.to_numpy()
        sizes = np.fromiter(map(len, each), np.int64, len(each)) // 4
        starts = np.cumsum(sizes) - sizes
        flat = np.frombuffer(b"".join(each), ID)
        counts = sizes[at]
        after = np.concatenate([[0], np.cumsum(counts)])
        # the place in ``flat`` of every id: its piece's start, and one more for each id within the piece
        place = np.arange(after[-1]) + np.repeat(starts[at] - after[:-1], counts)
        ids, cuts = flat[place], after[ends].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]

    def _ids(self, keys: list[str], latin: bool) -> list[bytes]:
        """The ids of distinct pieces (or words of odd texts), from memory or newly worked out."""
        memory = self.pieces if latin else self.words
        found = memory.find(keys)
        found[""] = b""
        new = [k for k in keys if k not in found]
        for i in range(0, len(new), 4096):
            some = new[i:i + 4096]
            for key, ids in zip(some, self._piece_ids(some) if latin else self._word_ids(some)):
                found[key] = ids
                if len(key) <= LONGEST:
                    memory.keep(key, ids)
        return [found[k] for k in keys]

    def _word_ids(self, words: list[str]) -> list[bytes]:
        return [np.asarray(x.ids, ID).tobytes() for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _piece_ids(self, pieces: list[str]) -> list[bytes]:
        one, = self.tokenizer.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)
        ids = np.asarray(one.ids, ID)
        ends = (np.flatnonzero(self.last[ids]) + 1).tolist()
        if len(ends) != len(pieces):  # a piece without an end mark: each by itself
            return self._word_ids(pieces)
        raw = ids.tobytes()
        return [raw[4 * start:4 * end] for start, end in zip([0, *ends], ends)]


class _Memory:
    """Ids of what was looked for lately: a recent part and the one before it, each of bounded size."""

    def __init__(self, chars: int):
        self.chars, self.held = chars, 0
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def find(self, keys: Iterable[str]) -> dict[str, bytes]:
        """What is known of ``keys`` (distinct). What the older part has moves to the recent one."""
        out, recent, older = {}, self.recent, self.older
        for key in keys:
            ids = recent.get(key)
            if ids is None:
                ids = older.get(key)
                if ids is None:
                    continue
                self.keep(key, ids)
            out[key] = ids
        return out

    def keep(self, key: str, ids: bytes) -> None:
        if self.held > self.chars:
            self.older, self.recent, self.held = self.recent, {}, 0
        self.recent[key] = ids
        self.held += len(key) + 1


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    return Encoder(path)
