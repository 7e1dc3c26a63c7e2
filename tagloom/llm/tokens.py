"""Byte-level BPE ids of whole texts, from a public tokenizer file."""

from __future__ import annotations

import json
import re
from array import array

#: Characters encoded at once.
PART = 1 << 20
#: The split rule that the tokenizer file names "ByteLevel".
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The rule without its look ahead, which needs no backtracking: the same unless a run of two or
#: more white space characters comes before a letter.
_PLAIN = PATTERN.replace(r"\s+(?!\S)|", "")
_RUNS = ("  ", "\n\n", "\n ", " \n")
_OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for
    themselves, the others for code points from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}


def byte_ranks(tokenizer_json: str) -> dict[bytes, int]:
    """Token bytes -> id, without special tokens. Ids are in merge order."""
    held = json.loads(tokenizer_json)
    special = {x["content"] for x in held["added_tokens"]}
    letters = _byte_letters()
    return {bytes(letters[c] for c in token): n for token, n in held["model"]["vocab"].items() if token not in special}


def added_ids(tokenizer_json: str) -> dict[str, int]:
    """String -> id of the added tokens, which are met as they stand."""
    held = json.loads(tokenizer_json)["added_tokens"]
    for x in held:
        if x.get("single_word") or x.get("lstrip") or x.get("rstrip") or x.get("normalized"):
            raise ValueError(f"added token {x['content']!r} is not met as it stands")
    return {x["content"]: x["id"] for x in held}


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit numbers.

    ``added``: strings of the file's added tokens get the ids of these, as in the
    tokenizer's own library; else they are ordinary text.
    """

    def __init__(self, tokenizer_json: str, added: bool = False) -> None:
        import tiktoken

        ranks = byte_ranks(tokenizer_json)
        self._exact, self._plain = (
            tiktoken.Encoding("bytes", pat_str=rule, mergeable_ranks=ranks, special_tokens={}) for rule in (PATTERN, _PLAIN)
        )

        self._added = added_ids(tokenizer_json) if added else {}
        longest = sorted(self._added, key=len, reverse=True)
        self._split = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self._split is None or not any(x in text for x in self._added):
            return b"".join(map(self._part, _parts(text)))
        out = []
        for n, x in enumerate(self._split.split(text)):
            out += [array("I", [self._added[x]]).tobytes()] if n % 2 else map(self._part, _parts(x))
        return b"".join(out)

    def _part(self, text: str) -> bytes:
        runs = any(x in text for x in _RUNS) or any(x in text for x in _OTHER_SPACE)
        return array("I", (self._exact if runs else self._plain).encode_ordinary(text)).tobytes()


def _parts(text: str):
    """Cuts of a long text before single spaces, where no token is split."""
    at = 0
    while len(text) - at > 2 * PART:
        cut = text.find(" ", at + PART)
        while cut >= 0 and (cut + 1 >= len(text) or text[cut - 1].isspace() or text[cut + 1].isspace()):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]
