"""Token ids of whole texts with a public tokenizer.

A text is split at white space where both of the tokenizers used here treat the two sides
independently.  Many texts are split at a time and each distinct part is looked up once; their ids
are put together from the parts' by index.  The tokenizers library encodes a part that is not known;
parts met twice or more are kept by the worker.  Parts of letters alone are one pre-token and go straight to the tokenizer's model; all others go
through its whole pipeline (normaliser, special tokens, pre-tokenizer)."""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from marquee.llm.common import worker_store

#: Distinct parts in each of the two generations kept per worker process (about 200 bytes each), and bits that tell
#: which parts (by hash) were met before.
KEPT_PARTS, MET_BITS = 1 << 17, 1 << 23
#: Bytes of text that are split at a time; longer texts are cut at blanks.
AT_ONCE = 1 << 21
LATIN_END = "ɐ"
_SPACE = "\t-\r \x85\xa0  -     　"
_SEGMENT = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
#: Any white space but a single blank or line feed between two other characters (or at the start): what to look for
#: first (plain searches are fast), and which of it is white space indeed.
_ODD_SIGNS = (b"  ", b"\n\n", b" \n", b"\n ", b"\t", b"\r", b"\x0b", b"\x0c", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
_ODD_SPACE = re.compile(rb"[\t\x0b\x0c\r]|[ \n][ \n]|[ \n]\Z|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def _is_odd(text: bytes) -> bool:
    return text[-1:] in (b" ", b"\n") or any(sign in text for sign in _ODD_SIGNS) and _ODD_SPACE.search(text) is not None


#: A blank between two characters that are neither blank nor line feed nor anything odd.
_CUT = re.compile(rb"(?<=[!-~]) (?=[!-~])")
#: Before a part that follows its neighbour without a blank (a byte that no UTF-8 text holds).
_JOINED = b"\xff"
_PLAIN_SEGMENT = re.compile(f" [^{_SPACE}]+|\n[^{_SPACE}]*")

#: Letters, then ASCII marks but the apostrophe: two pre-tokens.
_MARKED = re.compile(rb"([A-Za-z\x80-\xff]+)([!-&(-/:-@\[-`{-~]+)\Z")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next free one from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(free)}


class Encoder:
    """``encode(bytes of a text)`` -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.drops_space = spec["normalizer"] is not None  # the vocabulary of lower-case words
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.lead = "" if self.drops_space else self.letters[32]  # the blank before a word
        self.line_feed = self._whole("\n")
        self.known: dict = {}
        self.older: dict = {}
        self.met = bytearray(MET_BITS >> 3)
        self.ends: dict = {}  # runs of marks after a word

    @staticmethod
    def of(path: str) -> "Encoder":
        store = worker_store("encoders")
        if path not in store:
            store[path] = Encoder(path)
        return store[path]

    def _whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _name(self, word: bytes):
        """How the vocabulary writes a word of Latin letters (one pre-token, composed already); None if it is something else."""
        if word.isalpha():
            return (word.lower() if self.drops_space else word).decode()
        text = word.decode().lower() if self.drops_space else word.decode()
        if not text.isalpha() or max(text) >= LATIN_END:
            return None
        return text.encode().decode("latin-1").translate(self.letters)

    def _part(self, part: bytes) -> bytes:
        """``part`` stands after a blank, unless it starts with a line feed (in the vocabulary of words it stands alone) or with _JOINED."""
        if part[:1] == _JOINED:
            return self._whole(part[1:].decode())
        fresh = part[:1] == b"\n"  # a line feed is a token of its own before a letter
        word, lead, before = (part[1:], "", self.line_feed) if fresh else (part, self.lead, b"")
        ids = lambda name: before + _packed([t.id for t in self.model.tokenize(lead + name)])
        if name := self._name(word):
            return ids(name)
        out = None
        if (m := _MARKED.match(word)) and (name := self._name(m[1])):
            if (end := self.ends.get(m[2])) is None:
                end = self.ends[m[2]] = self._whole(m[2].decode())
            key = b"\n" + m[1] if fresh else m[1]
            if (head := self.known.get(key) or self.older.get(key)) is None:
                self._keep(key, head := ids(name))
            out = head + end
        if out is None:
            text = part.decode()
            out = self._whole(text if self.drops_space or text[0] == "\n" else " " + text)
        return out

    def _keep(self, part: bytes, ids: bytes) -> None:
        """Parts are kept from the second time on: most of those met once never come again."""
        bit = hash(part) & (MET_BITS - 1)
        if self.met[bit >> 3] >> (bit & 7) & 1:
            if len(self.known) > KEPT_PARTS:  # two generations: what is still in use moves to the new one
                self.older, self.known = self.known, {}
            self.known[part] = ids
        else:
            self.met[bit >> 3] |= 1 << (bit & 7)

    def _ids_of(self, parts: list) -> list[bytes]:
        """The ids of different parts, each standing after a blank."""
        got = list(map(self.known.get, parts))
        older, tokenize, lead, lower = self.older.get, self.model.tokenize, self.lead, self.drops_space
        met = self.met
        for i, ids in enumerate(got):
            if ids is None:
                part = parts[i]
                if (ids := older(part)) is None:
                    if part.isalpha():  # ASCII letters: the vocabulary writes them as they are
                        ids = array("I", [t.id for t in tokenize(lead + (part.lower() if lower else part).decode())]).tobytes()
                    else:
                        ids = self._part(part)
                bit = hash(part) & (MET_BITS - 1)
                if met[bit >> 3] >> (bit & 7) & 1:
                    self._keep(part, ids)
                else:
                    met[bit >> 3] |= 1 << (bit & 7)
                got[i] = ids
        if len(self.ends) > KEPT_PARTS:
            self.ends.clear()
        return got

    def _odd(self, text: str) -> bytes:
        """A text with odd white space: only the segments that have it, or stand first, go through the whole pipeline."""
        out = []
        for i, segment in enumerate(_SEGMENT.findall(text)):
            if i and _PLAIN_SEGMENT.fullmatch(segment):
                out += self._ids_of([segment.removeprefix(" ").encode()])
            else:
                out.append(self._whole(segment))
        return b"".join(out)

    def _pieces(self, text: bytes, at_once: int = AT_ONCE) -> list[tuple[bytes, bytes]]:
        """A text as (ids, rest) pieces: the ids come first, the rest's parts each stand after white space."""
        if self.drops_space:
            first, rest = b"", text
        elif _is_odd(text):
            return [(self._odd(text.decode()), b"")]
        else:
            cut = min((x for x in (text.find(b" "), text.find(b"\n")) if x >= 0), default=len(text))
            first, rest = self._whole(text[:cut].decode()) if cut else b"", text[cut:]
        out = []
        while len(rest) > at_once and (m := _CUT.search(rest, at_once)):
            out.append((first, rest[: m.start()]))
            first, rest = b"", rest[m.start() :]
        return [*out, (first, rest)]

    def _joined(self, pieces: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and where each piece's end."""
        rests = pa.array([rest for _, rest in pieces], pa.binary())
        if not self.drops_space:
            rests = pc.replace_substring(rests, b"\n", b" \n")
        # A mark behind a letter is a part of its own, so that fewer parts are different.
        rests = pc.replace_substring_regex(rests, b"([a-z])([,.]) ", b"\\1 \\2 " if self.drops_space else b"\\1 " + _JOINED + b"\\2 ")
        lists = pc.ascii_split_whitespace(rests.cast(pa.string())) if self.drops_space else pc.split_pattern(rests, b" ")
        coded = lists.flatten().dictionary_encode()
        parts = coded.dictionary.cast(pa.binary()).to_pylist()
        of_part = self._ids_of([p for p in parts if p])
        if b"" in parts:
            of_part.insert(parts.index(b""), b"")
        entry, offsets = coded.indices.to_numpy().astype(np.int64), lists.offsets.to_numpy().astype(np.int64)
        if not self.drops_space:  # a rest is empty or starts with white space, so that its first part is empty
            entry[offsets[:-1]] = len(of_part) + np.arange(len(pieces))
            of_part += [first for first, _ in pieces]
        size = np.fromiter(map(len, of_part), np.int64, len(of_part)) // 4
        values, begin = np.frombuffer(b"".join(of_part), "<u4"), np.cumsum(size) - size
        n = size[entry]
        ends = np.cumsum(n)
        kind = np.int32 if max(len(values), n.sum()) < 1 << 31 else np.int64  # of places: half the memory to go through
        at = np.repeat((begin[entry] - (ends - n)).astype(kind), n)
        at += np.arange(len(at), dtype=kind)
        return values[at], np.append(0, ends)[offsets[1:]]

    def encode_all(self, texts: list[bytes], at_once: int = AT_ONCE) -> list[np.ndarray]:
        """The ids (little-endian unsigned 32-bit integers) of each text; the more bytes are split at once, the fewer parts are looked up."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        group: list = []
        held = 0

        def done():
            ids, ends = self._joined([piece for _, piece in group])
            for (k, _), begin, end in zip(group, [0, *ends.tolist()], ends.tolist(), strict=False):
                out[k].append(ids[begin:end])

        for k, text in enumerate(texts):
            for piece in self._pieces(text, at_once):
                if held and held + len(piece[1]) > at_once:
                    done()
                    group, held = [], 0
                group.append((k, piece))
                held += len(piece[1])
        if group:
            done()
        return [ids[0] if len(ids) == 1 else np.concatenate(ids) for ids in out]

    def encode(self, text: bytes) -> bytes:
        return self.encode_all([text])[0].tobytes()


def _packed(ids) -> bytes:
    return array("I", ids).tobytes()


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
