"""URL filters: all glob rules simulated at once over each canonical URL.

A URL is canonical as ``.host/path`` with the host lower-cased. In a glob ``*`` is any
run of bytes without ``/``, ``**`` any run at all, ``?`` one byte; a glob has to
cover the whole canonical URL. The literal positions of all globs are packed
into the bits of a few 64-bit words. One step per byte shifts every state by one
position and masks it with the positions that accept the byte (Shift-And);
positions after a gap also keep themselves while the gap accepts the byte. The words
of a whole batch of URLs are advanced together.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField

from .batches import append_columns, raw_texts

# URLs whose states are advanced together: bounds the arrays of a step.
URLS_PER_STEP = 8192


@dataclass(frozen=True)
class Rule:
    """``label`` is shown with a match, ``verdict`` is allow or block.

    Of the rules that match, the one with the highest ``priority`` holds, then the first given.
    """

    glob: str
    verdict: str
    label: str | None = None
    priority: int = 0


def site_rule(text: str, verdict: str) -> Rule:
    """Rule for ``host/path-prefix``: the host and its subdomains; longer rules win."""
    return Rule(f"*.{text}**", verdict, text, len(text))


class GlobMasks:
    """Shift-And masks of all globs."""

    def __init__(self, globs: Sequence[str]) -> None:
        literals: list[int | None] = []  # byte of each position, None for any
        gap_before: dict[int, int] = {}  # position -> 1 a gap without slash, 2 any gap
        self.ends: list[tuple[int, int]] = []  # last position (or -1) and trailing gap
        starts: list[int] = []
        for glob in globs:
            raw, i, gap, first = glob.encode(), 0, 0, len(literals)
            while i < len(raw):
                if raw[i : i + 1] == b"*":
                    run = 1
                    while raw[i + run : i + run + 1] == b"*":
                        run += 1
                    gap, i = max(gap, 2 if run > 1 else 1), i + run
                    continue
                if gap:
                    gap_before[len(literals)] = gap
                literals.append(None if raw[i : i + 1] == b"?" else raw[i])
                gap, i = 0, i + 1
            if len(literals) == first:
                raise ValueError(f"a glob needs a character besides gaps: {glob!r}")
            starts.append(first)
            self.ends.append((len(literals) - 1, gap))
        # Position p is bit p: set while the positions before p are matched, so that
        # p is what comes next. One more bit per glob, after its last, says it is whole.
        n_bits = len(literals) + len(globs)
        place: list[int] = []
        whole: list[int] = []
        bit = 0
        bounds = [*starts, len(literals)]
        for k in range(len(globs)):
            for _ in range(bounds[k], bounds[k + 1]):
                place.append(bit)
                bit += 1
            whole.append(bit)
            bit += 1
        self.words = -(-n_bits // 64)
        self.accept = np.zeros((256, self.words), np.uint64)  # by literal
        self.stay = np.zeros((256, self.words), np.uint64)  # by gap
        self.start = np.zeros(self.words, np.uint64)
        self.whole = whole

        def put(mask: np.ndarray, where: int) -> None:
            mask[where // 64] |= np.uint64(1) << np.uint64(where % 64)

        for p, literal in enumerate(literals):
            for b in range(256) if literal is None else (literal,):
                put(self.accept[b], place[p])
            if p in gap_before:
                for b in range(256):
                    if gap_before[p] == 2 or b != 0x2F:
                        put(self.stay[b], place[p])
        for k, (_, gap) in enumerate(self.ends):
            put(self.start, place[starts[k]])
            if gap:
                for b in range(256):
                    if gap == 2 or b != 0x2F:
                        put(self.stay[b], whole[k])

    def match(self, texts: list[bytes]) -> np.ndarray:
        """``[url, glob]`` booleans: which globs cover which text."""
        state = np.tile(self.start, (len(texts), 1))
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-lengths, kind="stable")  # the running ones stay in front
        data = np.frombuffer(b"".join(texts), np.uint8)
        offset = np.concatenate([[0], np.cumsum(lengths)])[:-1][order]
        live = state[order]
        sorted_lengths = lengths[order]
        for t in range(int(lengths.max(initial=0))):
            n = int(np.searchsorted(-sorted_lengths, -t, side="left"))
            byte = data[offset[:n] + t]
            moved = live[:n] & self.accept[byte]
            shifted = moved << np.uint64(1)
            shifted[:, 1:] |= moved[:, :-1] >> np.uint64(63)
            live[:n] = shifted | (live[:n] & self.stay[byte])
        state[order] = live
        return np.stack(
            [(state[:, w // 64] >> np.uint64(w % 64)) & np.uint64(1) > 0 for w in self.whole], axis=1
        )


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A to Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(
    pages: DataFrame, rules: Sequence[Rule], *, url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """Pages plus ``host``, ``path``, ``rule`` (label of the rule that holds) and ``verdict``.

    A null url, or one without ``://``, has empty host and path. No match gives a null rule
    and the default verdict. Nothing is shuffled; the rules are a small table of
    the caller. Columns with the new names are replaced.
    """
    masks = GlobMasks([r.glob for r in rules]) if rules else None
    ranked = sorted(range(len(rules)), key=lambda k: (-rules[k].priority, k))
    url = F.col(url_col).cast("string")
    host, path = ("_" * len(max(pages.columns, key=len)) + n for n in ("host", "path"))  # names no page has
    located = pages.withColumns({host: url_host(url), path: url_path(url)})

    def judge(batch: pa.RecordBatch) -> list[list]:
        hosts, paths = batch.column(host), batch.column(path)
        texts = [b"." + h + p for h, p in zip(raw_texts(hosts), raw_texts(paths))]
        held = np.full(len(texts), -1)
        for i in range(0, len(texts) if masks else 0, URLS_PER_STEP):
            found = masks.match(texts[i : i + URLS_PER_STEP])
            for k in reversed(ranked):
                held[i : i + URLS_PER_STEP][found[:, k]] = k
        return [
            hosts,
            paths,
            [rules[k].label if k >= 0 else None for k in held],
            [rules[k].verdict if k >= 0 else default for k in held],
        ]

    fields = [StructField(n, StringType()) for n in ("host", "path", "rule", "verdict")]
    return append_columns(located, [host, path], fields, judge, keep=pages.columns)
