"""Secrets in texts: a keyword automaton, anchored expressions at its hits, checksums.

One Aho-Corasick automaton reads the whole text once and reports every place where a
keyword of some kind begins. Only there the kind's expression is tried, anchored at the
hit, so no expression ever searches. Hits of a kind come from left to right, and a match
ends all hits inside it: the matches are the leftmost ones that do not overlap, exactly
those that a search through the whole text would give. Kinds whose tokens carry a check of
their own count only if it holds.

Kinds without a word of their own take all short strings that they cannot do without: a
run of hexadecimal digits begins with four of them.

Each text is a task's work by itself: no shuffle and no state; the automaton is fixed.

Defined cases: a null text is an empty one and has no spans; equal rows are read alike,
each for itself; other columns are carried unread, whatever they are called; an empty table
gives an empty table. Positions are code points.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


@dataclass(frozen=True)
class Kind:
    """A kind of secret: where it may begin, how it reads there, and what makes it valid.

    ``keywords`` are lower case and found in either case; every match of ``pattern`` must
    begin with one of them. ``valid`` sees a match; one it refuses is no secret but still
    ends the hits inside it.
    """

    name: str
    keywords: tuple[str, ...]
    pattern: re.Pattern
    valid: Callable[[re.Match], bool]


_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_checksum(body: str) -> str:
    """CRC32 of a token's random part, as six digits of base 62."""
    left, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        left, digit = divmod(left, 62)
        digits = _BASE62[digit] + digits
    return digits


def _ends_with_checksum(match: re.Match) -> bool:
    body = match[1]
    return base62_checksum(body[:-6]) == body[-6:]


def _decoded(part: str) -> bytes:
    return base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))


def _is_signed_json(match: re.Match) -> bool:
    """Header and claims are JSON objects, and the header names an algorithm."""
    try:
        header, claims = (json.loads(_decoded(match[i])) for i in (1, 2))
    except (ValueError, RecursionError):
        return False
    return isinstance(claims, dict) and isinstance(header, dict) and isinstance(header.get("alg"), str)


def _is_framed_key(match: re.Match) -> bool:
    """The base64 of a private key holds one DER sequence of exactly its own length."""
    try:
        raw = base64.b64decode("".join(match[2].split()), validate=True)
    except (binascii.Error, ValueError):
        return False
    if len(raw) < 2 or raw[0] != 0x30:
        # keys of the other common container name it
        return raw.startswith(b"openssh-key-v1\0")
    if raw[1] < 0x80:
        return len(raw) == 2 + raw[1]
    width = raw[1] & 0x7F
    return len(raw) == 2 + width + int.from_bytes(raw[2 : 2 + width], "big")


_HEX_STARTS = tuple(map("".join, product("0123456789abcdef", repeat=4)))

#: Kinds of the base; order decides between spans with the same start.
BASE_KINDS: Sequence[Kind] = (
    Kind(
        "assign",
        ("password", "passwd", "secret", "token", "apikey", "api_key"),
        re.compile(
            r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
            re.ASCII,
        ),
        lambda match: len(match[2]) >= 6,
    ),
    Kind("access", ("akia",), re.compile("AKIA[A-Z0-9]+"), lambda match: len(match[0]) >= 20),
    Kind("hex", _HEX_STARTS, re.compile("[0-9a-f]+"), lambda match: len(match[0]) >= 24),
)

#: Kinds whose tokens carry a checksum, or a frame that must add up.
CHECKED_KINDS: Sequence[Kind] = (
    Kind(
        "forge_token",
        ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
        re.compile("gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])"),
        _ends_with_checksum,
    ),
    Kind("package_token", ("npm_",), re.compile("npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), _ends_with_checksum),
    Kind(
        "signed_token",
        ("eyj",),
        # only at the start of a run of its letters, each of which is then read once
        re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]++)\.(eyJ[A-Za-z0-9_-]++)\.([A-Za-z0-9_-]*+)"),
        _is_signed_json,
    ),
    Kind(
        "private_key",
        ("-----begin ",),
        re.compile(r"-----BEGIN ([A-Z ]{0,40})PRIVATE KEY-----([A-Za-z0-9+/=\s]++)-----END \1PRIVATE KEY-----"),
        _is_framed_key,
    ),
)

KINDS = (*BASE_KINDS, *CHECKED_KINDS)

_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


class Scanner:
    """The automaton over the keywords of some kinds."""

    def __init__(self, kinds: Sequence[Kind]):
        import ahocorasick

        by_keyword: dict[str, list[int]] = {}
        for number, kind in enumerate(kinds):
            for keyword in kind.keywords:
                by_keyword.setdefault(keyword, []).append(number)
        self.kinds = kinds
        self.automaton = ahocorasick.Automaton()
        for keyword, numbers in by_keyword.items():
            self.automaton.add_word(keyword, (len(keyword) - 1, tuple(numbers)))
        self.automaton.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """``start, number of the kind, end`` in this order."""
        lower = text.lower()
        if len(lower) != len(text):  # some letter grew; places must stay
            lower = text.translate(_LOWER)
        hits: list[list[int]] = [[] for _ in self.kinds]
        for end, (behind, numbers) in self.automaton.iter(lower):
            for number in numbers:
                hits[number].append(end - behind)
        found = []
        for number, (kind, starts) in enumerate(zip(self.kinds, hits)):
            done = 0
            # hits come by their ends, so keywords of several lengths may be out of order
            for start in sorted(starts):
                if start < done:
                    continue
                match = kind.pattern.match(text, start)
                if match:
                    done = match.end()
                    if kind.valid(match):
                        found.append((start, number, done))
        return sorted(found)


@lru_cache(maxsize=4)
def _scanner(names: tuple[str, ...]) -> Scanner:
    return Scanner([kind for kind in KINDS if kind.name in names])


def find_secrets(text: Column, kinds: Iterable[Kind] = KINDS) -> Column:
    """Spans ``kind, start, end`` of a text by start, then in the order of the kinds."""
    names = tuple(kind.name for kind in kinds)

    @F.arrow_udf(SPANS)
    def find(texts: pa.Array) -> pa.Array:
        scanner = _scanner(names)
        kind_names = [kind.name for kind in scanner.kinds]
        out = []
        for value in texts:
            spans = scanner.spans(value.as_py()) if value.is_valid else []
            out.append([{"kind": kind_names[k], "start": a, "end": b} for a, k, b in spans])
        return pa.array(out, _SPANS_ARROW)

    return find(text)


def scan_secrets(docs: DataFrame, text: str = "text", kinds: Iterable[Kind] = KINDS) -> DataFrame:
    """``row`` (the document as it came) and its ``spans``."""
    rows = docs.select(F.struct("*").alias("row"))
    return rows.select("row", find_secrets(F.col("row")[text], kinds).alias("spans"))


def mask_spans(text: Column, spans: Column, mask: str = "*") -> Column:
    """The text with every code point of its spans replaced; overlaps do no harm."""
    return F.aggregate(
        F.coalesce(spans, F.array().cast(SPANS)),
        F.coalesce(text, F.lit("")),
        lambda t, s: F.overlay(t, F.repeat(F.lit(mask), s["end"] - s["start"]), s["start"] + 1, s["end"] - s["start"]),
    )
