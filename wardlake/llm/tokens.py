"""Token ids of whole texts by the ``tokenizers`` library, cached by pretoken.

A BPE model encodes every pretoken by itself, so the ids of a text are those
of its pretokens, one after another. Natural text repeats its words: here the
library encodes each distinct pretoken once per worker, and a text's ids are
the joined cache entries. A pretoken goes to the model itself, in its byte-level
signs: the signs in ``SAFE_RANGES`` are left as they are by the known normalisers. The split into pretokens is done here only for
texts made of characters on which this module's regular expression surely
agrees with the library's (``SAFE_RANGES``); any other text goes to the library
whole, and so does every text if the tokenizer file has a pipeline that is
not known here. Either way the ids equal ``encode(text).ids``.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata

import numpy as np

from .common import worker_state

#: Tab, line feed, carriage return, printable ASCII, Latin letters and signs
#: below U+0250 but for the no-break space, soft hyphen and dotted capital I,
#: and common dashes, quotes and dots.
SAFE_RANGES = ((0x09, 0x0A), (0x0D, 0x0D), (0x20, 0x7E), (0xA1, 0xAC), (0xAE, 0x12F), (0x131, 0x24F), (0x2010, 0x2027))
#: Pretokens longer than this are not kept in the cache.
LONGEST_KEPT = 40
#: Bytes that remember which pretokens were met once (a power of two).
MET = 1 << 22


#: The byte-level alphabet: printable bytes stand for themselves, the others, in order, for the signs from U+0100 on.
_PLAIN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTE_SIGNS = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}
SPACE_SIGN = chr(BYTE_SIGNS[0x20])


def _of(kind: str) -> str:
    return "".join(re.escape(chr(c)) for a, b in SAFE_RANGES for c in range(a, b + 1)
                   if unicodedata.category(chr(c)).startswith(kind))


def _patterns() -> dict[str, re.Pattern]:
    # letters come first, as most pretokens are words; the other parts begin with other signs, so the split is the library's
    let, num = _of("L"), _of("N")
    return {
        "unsafe": re.compile("[^" + "".join(f"{chr(a)}-{chr(b)}" if b > a else chr(a) for a, b in SAFE_RANGES).replace("\t-\n", r"\t\n").replace("\r", r"\r") + "]"),
        "byte": re.compile(rf" ?[{let}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{num}]+| ?[^\s{let}{num}]+|\s+(?!\S)|\s+"),
        "word": re.compile(rf"[{let}]+|'s|'t|'re|'ve|'m|'ll|'d|[{num}]|[^\s{let}{num}]+"),
    }


def pipeline(spec: dict) -> str | None:
    """'byte' or 'word' where the file's normaliser and pretokeniser are of a known form, else None."""
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if any(t.get("normalized") or t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens", [])):
        return None
    if spec.get("post_processor") or spec.get("model", {}).get("type") != "BPE" or spec["model"].get("dropout"):
        return None
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
        return "byte"
    parts = pre.get("pretokenizers", [])
    if (pre.get("type") == "Sequence" and [p["type"] for p in parts] == ["Split", "ByteLevel"]
            and parts[0]["behavior"] == "Removed" and parts[0]["invert"] and not parts[1]["use_regex"]
            and not parts[1]["add_prefix_space"]
            and parts[0]["pattern"].get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
            and [n["type"] for n in (norm or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]):
        return "word"
    return None


class Cache(dict):
    """Ids by pretoken. A pretoken is kept from its second meeting on (a bit for its hash remembers the first; a clash only
    keeps one earlier), so words that occur once cost no memory. Two generations: when the young one is full it becomes
    the old one, and what is still in use comes back from there, so frequent pretokens stay and memory is bounded.

    A pretoken that is kept is one look-up; only others reach ``__missing__``."""

    def __init__(self, tok, keep: int):
        super().__init__()
        self.pieces, self.keep, self.old = tok.model.tokenize, keep, {}
        self.met, self.marks = bytearray(MET), 0

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            if word.isascii() and word.isprintable():
                signs = word.replace(" ", SPACE_SIGN)
            else:
                signs = word.encode().decode("latin-1").translate(BYTE_SIGNS)
            found = [p.id for p in self.pieces(signs)]
            ids = struct.pack(f"<{len(found)}I", *found)
            if len(word) > LONGEST_KEPT:
                return ids
            at = hash(word) & (MET - 1)
            if not self.met[at]:
                self.met[at] = 1
                self.marks += 1
                if self.marks > MET // 2:
                    self.met, self.marks = bytearray(MET), 0
                return ids
        self[word] = ids
        if len(self) > self.keep:
            self.old = dict(self)
            self.clear()
        return ids


class Encoder:
    """``ids(texts)``: for each text its ids as little-endian unsigned 32-bit numbers, joined."""

    def __init__(self, path: str, keep: int = 200_000):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.kind = pipeline(spec)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.lower = self.kind == "word"
        pats = _patterns()
        self.unsafe, self.split = pats["unsafe"].search, self.kind and pats[self.kind].findall
        self.cache = Cache(self.tok, keep)

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def simple(self, text: str) -> bool:
        return bool(self.kind) and not self.unsafe(text) and not any(a in text for a in self.added)

    def ids(self, texts: list[str]) -> list[bytes]:
        get, out = self.cache.__getitem__, []
        for t in texts:
            if self.simple(t):
                out.append(b"".join(map(get, self.split(t.lower() if self.lower else t))))
            else:
                out.append(self.whole(t))
        return out


def encoder(path: str) -> Encoder:
    """This worker's encoder for ``path``, kept over its tasks."""
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return worker_state(f"encoder:{path}", lambda: Encoder(path), large=True)
