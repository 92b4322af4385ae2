"""Token ids of whole texts by a public word-level BPE, a word encoded once while it is in use.

The tokenizer drops white space and never joins pieces across it, so a text's ids are those
of its words, one after the other. Workers keep the ids of the words they met lately.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import cache


#: A worker has one core; threads of its own would only add memory.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words whose ids a worker keeps in each of two generations.
KEPT_WORDS = 250_000


@cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Lower-case Latin letters, each one code point that normalization leaves alone, then marks other
#: than apostrophes: a word that the tokenizer splits there and nowhere else.
_PLAIN = re.compile("([a-z\u00df-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\\[-`{-~]*)").fullmatch
#: How byte-level models write the UTF-8 bytes of those letters: printable bytes as themselves, the
#: others as code points from 256 on, in order.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_OTHERS = {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in _PRINTED)}
_AS_BYTES = {c: "".join(chr(b) if b in _PRINTED else _OTHERS[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}
#: The same with upper case, for vocabularies that keep it.
_CASED = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\\[-`{-~]*)").fullmatch


class Memory:
    """Ids of the words met lately: when the younger generation is full it becomes the older, and what
    is still in use moves over again."""

    def __init__(self) -> None:
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def learn(self, words: set[bytes], path: str) -> dict[bytes, bytes]:
        if len(self.young) > KEPT_WORDS:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        new = [w for w in words if w not in young]
        if old:
            young.update((w, old[w]) for w in new if w in old)
            new = [w for w in new if w not in old]
        if not new:
            return young
        tokens = tokenizer(path)
        one, rest = tokens.model.tokenize, []
        for w in new:
            if (plain := _PLAIN(word := w.decode().lower())) is None or len(word) > 1000:
                rest.append(w)
                continue
            letters, marks = plain.groups()
            ids = array("I", [t.id for t in one(letters if letters.isascii() else letters.translate(_AS_BYTES))])
            if marks:
                ids.extend([t.id for t in one(marks)])
            young[w] = ids.tobytes()
        for k in range(0, len(rest), 4096):
            part = rest[k : k + 4096]
            found = tokens.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
            young.update((w, array("I", e.ids).tobytes()) for w, e in zip(part, found, strict=True))
        return young


_memory: dict[str, Memory] = {}

#: How the word-level vocabularies normalize and split.
_NORMALIZER = ("NFC", "Replace", "Lowercase")
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


@cache
def by_words(path: str) -> bool:
    """Whether the tokenizer lower-cases, drops white space and never joins pieces across it."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    normal = (made.get("normalizer") or {}).get("normalizers") or []
    split = ((made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    return tuple(x["type"] for x in normal) == _NORMALIZER and (split.get("pattern") or {}).get("Regex") == _SPLIT and split.get("behavior") == "Removed" and bool(split.get("invert"))


@cache
def by_spaces(path: str) -> bool:
    """Whether the tokenizer is byte-level, with the usual pattern: a single space belongs to the word after it."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    split = made.get("pre_tokenizer") or {}
    return made.get("normalizer") is None and made.get("post_processor") is None and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and bool(split.get("use_regex", True))


#: Longer pieces between spaces are encoded each time.
LONG_PIECE = 256


class Spaced(Memory):
    """Ids of what stands between single spaces. A piece's key is the piece, which then has its space before it; a stretch
    that is taken as it stands has a space before its key, so the two can't be mistaken."""

    @staticmethod
    def _edges(piece: bytes) -> tuple[bool, bool]:
        """Whether the piece begins, and ends, with something else than white space."""
        text = piece.decode()
        return (not text[0].isspace(), not text[-1].isspace()) if text else (False, False)

    def _encode(self, keys: list[bytes], path: str) -> list[bytes]:
        tokens = tokenizer(path)
        one, out, rest = tokens.model.tokenize, [b""] * len(keys), []
        for k, key in enumerate(keys):
            text = key[1:].decode() if key[:1] == b" " else " " + key.decode()
            if (plain := _CASED(text.removeprefix(" "))) is None or len(text) > 1000:
                rest.append((k, text))
                continue
            letters, marks = plain.groups()
            ids = array("I", [t.id for t in one(_OTHERS[32] * (text[0] == " ") + (letters if letters.isascii() else letters.translate(_AS_BYTES)))])
            if marks:
                ids.extend([t.id for t in one(marks)])
            out[k] = ids.tobytes()
        for (k, _), e in zip(rest, tokens.encode_batch_fast([text for _, text in rest], add_special_tokens=False), strict=True):
            out[k] = array("I", e.ids).tobytes()
        return out

    def learn(self, words: set[bytes], path: str) -> dict[bytes, bytes]:
        """Those of the keys that are short and, between spaces, begin and end with no white space."""
        if len(self.young) > KEPT_WORDS:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        new = [w for w in words if w not in young]
        if old:
            young.update((w, old[w]) for w in new if w in old)
            new = [w for w in new if w not in old]
        new = [w for w in new if len(w) <= LONG_PIECE and (w[:1] == b" " or all(self._edges(w)))]
        # lines: one end of line between two words is a piece of its own, and the second word has no space before it
        lines = {w: w.split(b"\n") for w in new if b"\n" in w and w[:1] != b" "}
        lines = {w: parts for w, parts in lines.items() if all(all(self._edges(p)) for p in parts)}
        wanted = {k for parts in lines.values() for k in (parts[0], *(b" " + p for p in parts[1:]))} | ({b" \n"} if lines else set())
        more = [w for w in wanted if w not in young and w not in lines]
        plain = [*(w for w in new if w not in lines), *more]
        plain = list(dict.fromkeys(plain))
        for k in range(0, len(plain), 4096):
            part = plain[k : k + 4096]
            young.update(zip(part, self._encode(part, path), strict=True))
        for w, parts in lines.items():
            young[w] = young[b" \n"].join([young[parts[0]], *(young[b" " + p] for p in parts[1:])])
        return young

    def whole(self, pieces: list[bytes], path: str) -> bytes:
        """A text with runs of white space or long pieces: cut only at single spaces between other characters."""
        keys, edges = [b" " + pieces[0]], [self._edges(p) for p in pieces]
        for k in range(1, len(pieces)):
            if edges[k - 1][1] and edges[k][0]:
                keys.append(pieces[k])
            else:  # goes on: as it stands, with the space that it begins with
                keys[-1] = keys[-1] + b" " + pieces[k] if keys[-1][:1] == b" " else b"  " + keys[-1] + b" " + pieces[k]
        known = self.learn(set(keys), path)
        return b"".join(known[k] if k in known else self._encode([k], path)[0] for k in keys)

    def encode(self, docs: list[bytes], path: str) -> list[bytes]:
        split = [x.split(b" ") for x in docs]
        known = self.learn(set().union(*(p[1:] for p in split), (b" " + p[0] for p in split)), path)
        out = []
        for pieces in split:
            first = known.get(b" " + pieces[0])
            if first is not None and (len(pieces) == 1 or self._edges(pieces[0])[1]):
                try:
                    out.append(b"".join([first, *map(known.__getitem__, pieces[1:])]))
                    continue
                except KeyError:
                    pass
            out.append(self.whole(pieces, path))
        return out


def encode(docs: list[bytes], path: str) -> list[bytes]:
    """The ids of each UTF-8 text, as little-endian unsigned 32-bit values.

    Of a word-level vocabulary words are encoded once, split at bytes 9 to 13 and 32; it lower-cases, so A-Z are
    lowered first unless a text may hold the name of a special token, which counts only as written. Of a byte-level
    one pieces between single spaces are. Any other vocabulary encodes whole texts."""
    if by_spaces(path):
        memory = _memory.setdefault(path, Spaced())
        return [ids for i in range(0, len(docs), 64) for ids in memory.encode(docs[i : i + 64], path)]
    if not by_words(path):
        found = tokenizer(path).encode_batch_fast([x.decode() for x in docs], add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]
    memory = _memory.setdefault(path, Memory())
    out: list[bytes] = []
    for i in range(0, len(docs), 64):
        split = [(x if b"<|" in x else x.lower()).split() for x in docs[i : i + 64]]
        known = memory.learn(set().union(*split), path)
        out += [b"".join(map(known.__getitem__, words)) for words in split]
    return out
