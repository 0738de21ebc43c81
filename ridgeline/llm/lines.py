"""Quality rules on lines first, then on what the lines leave of a document.

A line fails when it looks like navigation (columns of separators, or arrows),
like boilerplate (licence, cookie, copyright or sign-in wording in English,
Spanish, French or German), like broken punctuation (a short line without terminal punctuation,
or symbols or exclamation marks on most words) or when it is one word over and over.
Lines fail on their own words only. Lines that fail go; a document is rejected when less
than KEEP_SHARE of its words is left.

Base counts are reported beside: see base_counts().

Defined results: null or empty text has no words, fails the base rules and is
rejected; lines without words neither pass nor fail; rows are independent, so
ties and repeated rows each get the same result; extra columns are ignored."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WORD_PATTERN, Words, chunks, gram_hashes, input_columns

#: A document keeps at least this share of its words, or it is rejected.
KEEP_SHARE = 0.5
LEAST_WORDS = 50
#: A shorter line needs terminal punctuation: longer ones may be wrapped in mid-sentence.
WHOLE_LINE = 8

_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
# Signs of navigation, endings and wording that mark a line; the SQL below uses the same patterns.
NAVIGATION = r"^[|>»«›‹•·*#$%&<=/~-]+$"
ODD_END = r"(!!+|[#*$%&][#*$%&]+)$"
TERMINAL = r"[.!?:;…。！？][\x22')\]”’»]*[ \t\r]*$"
BOILERPLATE = (
    r"((licensed|released|published|distributed) under|all rights reserved|terms of (use|service)|privacy policy|cookie policy|copyright \(?c\)?|permission is hereby granted|"
    r"without warrant(y|ies)|javascript (is|must)|sign in to|log in to|subscribe to our|"
    r"todos los derechos reservados|bajo (la |una )?licencia|t[ée]rminos (de uso|del servicio)|pol[íi]tica de (privacidad|cookies)|inicia sesi[óo]n|suscr[íi]bete|"
    r"tous droits r[ée]serv[ée]s|sous (la |une )?licence|conditions d.utilisation|politique de (confidentialit[ée]|cookies)|connectez-vous|abonnez-vous|"
    r"alle rechte vorbehalten|unter (der|einer) [^.]*lizenz|nutzungsbedingungen|datenschutz(erkl[äa]rung|richtlinie)|melden sie sich an|abonnieren sie)"
)
_WORD, _NAVIGATION, _ODD_END, _TERMINAL, _BOILERPLATE = map(re.compile, (WORD_PATTERN, NAVIGATION, ODD_END, TERMINAL, BOILERPLATE))
_TO_LOWER = {k: k + 32 for k in range(65, 91)}


def judge_line(line: str) -> tuple[str | None, int]:
    """The rule that a line breaks, or None, and its words."""
    words = _WORD.findall(line)
    n = len(words)
    if not n:
        return None, 0
    if n >= 3 and 3 * sum(1 for w in words if _NAVIGATION.match(w)) >= n:
        return "navigation", n
    if n <= 40 and _BOILERPLATE.search(line.translate(_TO_LOWER)):
        return "boilerplate", n
    if n < WHOLE_LINE and not _TERMINAL.search(line) or n >= 3 and 2 * sum(1 for w in words if _ODD_END.search(w)) >= n:
        return "punctuation", n
    if n >= 8 and 4 * len(set(words)) <= n:
        return "repetition", n
    return None, n


def line_fails(line: str) -> str | None:
    return judge_line(line)[0]


def clean_text(text: str | None) -> tuple[str, int, int]:
    """The text without failing lines, its words and the words of the whole text."""
    lines = (text or "").split("\n")
    judged = [judge_line(x) for x in lines]
    return "\n".join(x for x, (f, _) in zip(lines, judged) if f is None), sum(n for f, n in judged if f is None), sum(n for _, n in judged)


def base_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    out: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    for i, j, data, off in chunks(texts):
        w = Words(data, off)
        inside = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
        of_word = np.concatenate([[0], np.cumsum(inside[w.end] - inside[w.start])])
        symbols = np.concatenate([[0], np.cumsum(_SYMBOLS[data])])
        out["n_words"].append(np.diff(w.first))
        out["word_chars"].append(np.diff(of_word[w.first]))
        out["n_symbols"].append(np.diff(symbols[off]))
        for k in range(j - i):
            grams = gram_hashes(w.hash[w.first[k] : w.first[k + 1]], 3)
            covered = np.zeros(len(grams) + 2, dtype=bool)
            if len(grams):
                _, inverse, count = np.unique(grams, return_inverse=True, return_counts=True)
                twice = np.flatnonzero(count[inverse] > 1)
                for s in range(3):
                    covered[twice + s] = True
            out["n_repeat_words"].append([int(covered.sum())])
            lines = [x for x in bytes(data[off[k] : off[k + 1]]).split(b"\n") if x.split()]
            out["n_dup_lines"].append([len(lines) - len(set(lines))])
    return {k: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for k, v in out.items()}


def judge_lines(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """Every document (doc_id, text) with its base counts, base_failed, clean_words, cleaned text (if wanted) and kept."""

    def judge(batches):
        for b in batches:
            texts = b.column(b.schema.get_field_index("text"))
            for first in range(0, b.num_rows, 512):
                part = texts.slice(first, 512)
                base = base_counts(part)
                failed = (base["n_words"] < LEAST_WORDS) | (100 * base["n_repeat_words"] > 50 * base["n_words"])
                cleaned = [clean_text(t) for t in part.to_pylist()]
                clean = np.array([c for _, c, _ in cleaned], dtype=np.int64)
                words = np.array([n for _, _, n in cleaned], dtype=np.int64)
                kept = ~failed & (clean >= KEEP_SHARE * words)
                out = {"doc_id": b.column(b.schema.get_field_index("doc_id")).slice(first, 512), **{k: pa.array(v) for k, v in base.items()}, "base_failed": pa.array(failed), "clean_words": pa.array(clean), "kept": pa.array(kept)}
                if with_text:
                    out["clean_text"] = pa.array([t for t, _, _ in cleaned], pa.string())
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, clean_words long, kept boolean"
    return input_columns(docs, "doc_id", "text").mapInArrow(judge, schema + (", clean_text string" if with_text else ""))


#: The same in DuckDB's SQL.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM d),
lw AS (SELECT doc_id, line, pos, regexp_extract_all(line, '{WORD_PATTERN}') AS ws FROM l),
j AS (
  SELECT *, len(ws) AS n,
    row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) > 1 AND len(ws) > 0 AS dup,
    (len(ws) >= 3 AND 3 * len(list_filter(ws, lambda w: regexp_matches(w, '{NAVIGATION}'))) >= len(ws))
    OR (len(ws) <= 40 AND len(ws) > 0 AND regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{BOILERPLATE}'))
    OR (len(ws) BETWEEN 1 AND {WHOLE_LINE - 1} AND NOT regexp_matches(line, '{TERMINAL.replace("'", "''")}'))
    OR (len(ws) >= 3 AND 2 * len(list_filter(ws, lambda w: regexp_matches(w, '{ODD_END}'))) >= len(ws))
    OR (len(ws) >= 8 AND 4 * len(list_distinct(ws)) <= len(ws)) AS fails
  FROM lw),
per AS (
  SELECT doc_id, sum(n)::BIGINT AS n_words, count(*) FILTER (WHERE dup) AS n_dup_lines, coalesce(sum(n) FILTER (WHERE NOT fails), 0)::BIGINT AS clean_words FROM j GROUP BY doc_id),
w AS (SELECT doc_id, unnest(regexp_extract_all(t, '{WORD_PATTERN}')) AS word, generate_subscripts(regexp_extract_all(t, '{WORD_PATTERN}'), 1) AS i FROM d),
g AS (SELECT doc_id, i, word, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS gram FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, i, word, gram IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, gram) > 1 AS twice FROM g),
r AS (
  SELECT doc_id, word, twice OR coalesce(lag(twice, 1) OVER o, false) OR coalesce(lag(twice, 2) OVER o, false) AS covered FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
rep AS (SELECT doc_id, count(*) FILTER (WHERE covered) AS n_repeat_words, sum(length(word))::BIGINT AS word_chars FROM r GROUP BY doc_id),
x AS (
  SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, clean_words
  FROM d JOIN per USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM x)
SELECT *, NOT base_failed AND clean_words >= {KEEP_SHARE} * n_words AS kept FROM f
"""
