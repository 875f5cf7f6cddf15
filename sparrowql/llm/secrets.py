"""Secret scans: fixed patterns, and dictionary-primed zstandard novelty.

Base kinds are ``assign``, ``access`` and ``hex`` (patterns below). The method
adds ``novel`` spans: a candidate is a long run that mixes letters and digits,
within ``REACH`` characters of a sensitive word on either side. Its marginal size is
the compressed size of its surroundings with it in its place, less that without
it, under a zstandard dictionary. Other copies of it are blanked out in the
surroundings, so a repeated secret stays novel. The size is measured against that of
``REFERENCES`` random strings of the same shape (letters for letters, digits for
digits; hex digits for hex) in the same place: names follow from the dictionary and
from names in use and take a smaller share, keys as much. A share of ``NOVELTY``
is reported, and of ``NOVELTY_OF_WORDS`` if the run is made of long words;
base spans that overlap go first.

The dictionary is trained on the driver from a bounded sample of code and
identifiers: the Python sources of the installed PySpark and of the standard
library (``SAMPLE_FILES``, ``SAMPLE_CHARACTERS``), case folded as all that is measured.

Null texts count as empty, and so do texts without a sensitive word for the method. The
operator is a map over rows: every row stays, repeats and null ids included, nothing
is shuffled, and an empty table gives an empty table. Whole texts are scanned; the
surroundings are the ``CONTEXT`` characters on each side of a candidate.
"""

from __future__ import annotations

import hashlib
import importlib.util
import os
import random
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from sparrowql.llm.shared import slices, trimmed, with_fields

KINDS = ("assign", "access", "hex", "novel")
#: The base patterns, and the least length of group 2 or of the match.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

#: Words that make a context sensitive.
SENSITIVE = re.compile(
    r"(?:passw|passphrase|pwd|secret|token|api[-_]?key|access[-_]?key|private[-_]?key|auth|bearer|credential|signature|client[-_]?id|connection[-_]?string)",
    re.IGNORECASE | re.ASCII,
)
#: What a candidate looks like: a long run without spaces, with padding, that mixes letters and digits.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.~-]{16,}={0,2}")
#: Characters between a sensitive word and a candidate, and of surroundings on each side.
REACH, CONTEXT = 64, 256
#: Least share of a random string's marginal size, and that of runs of words over WORD characters on average.
NOVELTY, NOVELTY_OF_WORDS, WORD = 0.87, 0.97, 5
REFERENCES, LEVEL = 4, 3
#: Bounds of the dictionary's sample: files, characters of each, sampled lines; and the dictionary's bytes.
SAMPLE_FILES, SAMPLE_CHARACTERS, SAMPLE_LINES, DICTIONARY_BYTES = 160, 40_000, 12_000, 65_536
_RUN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_HEX_RUN = re.compile(r"[0-9a-f-]+")


def _sources() -> list[str]:
    """The bounded sample: sources of PySpark and of the standard library, in the order of their paths."""
    pyspark, library = Path(next(iter(importlib.util.find_spec("pyspark").submodule_search_locations))), Path(os.__file__).parent  # type: ignore[union-attr, arg-type]
    files = [*sorted(pyspark.glob("*.py")), *sorted(pyspark.glob("sql/*.py")), *sorted(library.glob("*.py"))]
    step = max(1, len(files) // SAMPLE_FILES)
    return [f.read_text(encoding="utf-8", errors="replace")[:SAMPLE_CHARACTERS].lower() for f in files[::step]]


@lru_cache(maxsize=1)
def dictionary() -> tuple[bytes, str]:
    """A trained dictionary, and common words that precede what is measured, so that short surroundings count like long ones."""
    sources = _sources()
    counts = Counter(w for text in sources for w in re.findall(r"[a-z]{3,}", text))
    words = [w for w, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])) if n > 1]
    lines = sorted({line.strip() for text in sources for line in text.split("\n") if len(line.strip()) > 12})
    rng = random.Random(1)
    samples = [f"{w}_".encode() for w in words] + [line.encode() for line in rng.sample(lines, min(SAMPLE_LINES, len(lines)))]
    rng.shuffle(samples)
    return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=64, d=8).as_bytes(), " ".join(words[:400:7]) + "\n"


class Novelty:
    def __init__(self, trained: tuple[bytes, str]):
        primed = zstandard.ZstdCompressionDict(trained[0], dict_type=zstandard.DICT_TYPE_FULLDICT)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=primed, write_content_size=False, write_dict_id=False)
        self.before = trained[1]

    def _size(self, text: str) -> int:
        return len(self.compressor.compress((self.before + text).lower().encode("utf-8", "surrogatepass")))

    def share(self, text: str, start: int, end: int) -> float:
        """Bytes that text[start:end] adds to its surroundings, over those that random strings of its shape add there."""
        token = text[start:end]
        before, after = (x.replace(token, "") for x in (text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]))
        alone = self._size(before + after)
        rng = random.Random(zlib.crc32(token.encode()))
        hex_ = _HEX_RUN.fullmatch(token.lower())

        def alike(c: str) -> str:
            if hex_:
                return rng.choice("0123456789abcdef") if c.isalnum() else c
            return rng.choice("abcdefghijklmnopqrstuvwxyz") if c.isalpha() else rng.choice("0123456789") if c.isdigit() else c

        random_ = [self._size(before + "".join(map(alike, token)) + after) - alone for _ in range(REFERENCES)]
        return (self._size(before + token + after) - alone) * REFERENCES / max(1, sum(random_))

    def reported(self, text: str, start: int, end: int) -> bool:
        token = text[start:end]
        made_of_words = len(_RUN.findall(token)) * WORD < len(token)
        return self.share(text, start, end) >= (NOVELTY_OF_WORDS if made_of_words else NOVELTY)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, sorted."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    if long_hex(text):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


_IS_HEX = np.zeros(256, bool)
_IS_HEX[list(b"0123456789abcdef")] = True


def long_hex(text: str) -> bool:
    """Whether a run of HEX_LEAST hex digits is there."""
    if len(text) < HEX_LEAST:
        return False
    other = np.flatnonzero(~_IS_HEX[np.frombuffer(text.encode(), np.uint8)])
    if not len(other):
        return True
    return bool(other[0] >= HEX_LEAST or len(text.encode()) - 1 - other[-1] >= HEX_LEAST or np.diff(other).max(initial=0) > HEX_LEAST)


def mixed(token: str) -> bool:
    return any(c.isdigit() for c in token) and any(c.isalpha() for c in token)


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty) -> list[tuple[int, int, int]]:
    words = [m.span() for m in SENSITIVE.finditer(text)]
    if not words:
        return []
    starts, ends, out = [a for a, _ in words], [b for _, b in words], []
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        before, after = bisect_right(ends, start) - 1, bisect_left(starts, end)  # sensitive words next to it, not within
        near = before >= 0 and start - ends[before] <= REACH or after < len(words) and starts[after] - end <= REACH
        if near and mixed(m[0]) and not any(a < end and start < b for a, _, b in base) and novelty.reported(text, start, end):
            out.append((start, 3, end))
    return out


def scan(text: str, novelty: Novelty) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans), each (start, kind, end) sorted."""
    base = base_spans(text)
    return base, sorted(base + novel_spans(text, base, novelty))


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]]) if spans else text


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_assign, n_access, n_hex, base_sha256, spans, n_novel."""
    schema = with_fields(
        docs.select(id_col).schema, n_assign="long", n_access="long", n_hex="long", base_sha256="string", spans="string", n_novel="long"
    )

    trained = dictionary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(trained)
        for batch in batches:
            for part in slices(batch, text_col):
                counts, digests, spans = [], [], []
                for text in part.column(text_col).to_pylist():
                    base, every = scan(text or "", novelty)
                    kinds = [k for _, k, _ in every]
                    counts.append([kinds.count(k) for k in range(4)])
                    digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                    spans.append(written(every))
                by_kind = [pa.array([c[k] for c in counts], pa.int64()) for k in range(4)]
                columns = [part.column(id_col), *by_kind[:3], pa.array(digests, pa.string()), pa.array(spans, pa.string()), by_kind[3]]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.select(id_col, text_col).mapInArrow(trimmed(run), schema)


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mark: str = "<SECRET>") -> DataFrame:
    """The input rows with every span replaced by ``mark`` and the length column set anew; null texts stay null."""
    schema = docs.schema

    trained = dictionary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(trained)
        for batch in batches:
            for part in slices(batch, text_col):
                old = part.column(text_col).to_pylist()
                new = [None if t is None else redacted(t, scan(t, novelty)[1], mark) for t in old]
                columns = dict(zip(schema.names, part.columns, strict=True))
                columns[text_col] = pa.array(new, pa.string())
                if length_col in columns:
                    kind = columns[length_col].type
                    lengths = columns[length_col].to_pylist()
                    columns[length_col] = pa.array([n if a == b else len(b) for n, a, b in zip(lengths, old, new, strict=True)], kind)
                yield pa.RecordBatch.from_arrays(list(columns.values()), schema.names)

    return docs.mapInArrow(trimmed(run), schema)


def stage(spark, docs: DataFrame) -> DataFrame:
    """Pipeline stage: every document, with its secrets replaced."""
    return redact_secrets(docs)


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + f"|{_either_case('api')}_?{_either_case('key')}"


def _kind_sql(kind: int, pattern: str, group: int, least: int) -> str:
    """DuckDB SQL for the spans of one kind: a match starts behind all pieces and matches before it."""
    quoted = pattern.replace("'", "''")
    return f"""
  SELECT rn, {kind} AS kind, '{KINDS[kind]}' AS name, a, a + length(m) AS b FROM (
    SELECT rn, m, g, sum(length(s)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY rn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM (
      SELECT rn, unnest(m) AS m, unnest(g) AS g, unnest(s[1:len(m)]) AS s, unnest(range(len(m))) AS i FROM (
        SELECT rn, regexp_extract_all(t, '{quoted}') AS m, regexp_extract_all(t, '{quoted}', {group}) AS g, regexp_split_to_array(t, '{quoted}') AS s FROM d))
    WINDOW w AS (PARTITION BY rn ORDER BY i)) WHERE length(g) >= {least}"""


#: The base spans in DuckDB.
BASE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS t FROM documents
), x AS ({_kind_sql(0, "(" + _NAMES + ")[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, ASSIGN_LEAST)}
  UNION ALL {_kind_sql(1, "AKIA[A-Z0-9]+", 0, ACCESS_LEAST)}
  UNION ALL {_kind_sql(2, "[0-9a-f]{24,}", 0, HEX_LEAST)}
), s AS (SELECT rn, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2,
    string_agg(name || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT), ',' ORDER BY a, kind) AS said FROM x GROUP BY rn)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(said, '')) AS base_sha256
FROM d LEFT JOIN s USING (rn)
"""
