"""Line-first quality rules: judge every line, drop those that fail, then judge what is left.

``clean_lines`` returns per document its counts, the cleaned text and the
verdict. Each \\n-split line with a word is failed by the first of these rules
that applies: boilerplate phrase, symbols, navigation, shouting, repetition,
missing end punctuation (lines under ``prose_words`` words). Phrases and capitals are those of A-Z and \u00c0-\u00de, ends are whole characters. A document is rejected if its own counts fail
(fewer than ``min_words`` words; more than ``max_repeat_pct`` percent of its
words inside repeated 8-word windows) or if failing lines hold more than
``max_loss_pct`` percent of its words.

Edge cases: null text is an empty text; an empty text has no lines, zero counts
and fails ``min_words``; lines without a word are kept and never count; repeated
rows are judged one by one; other columns of the input pass through untouched
(a clashing output name replaces the input's column). A row's verdict depends on that row alone. One pass, no shuffle;
memory is about 75 bytes for each byte of a chunk of half a megabyte, or of the longest single text where that is longer.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lossbook.llm.arrow import map_batches
from lossbook.llm.words import chunks, per_doc, spans_hash

# Phrases that mark page furniture rather than prose, in the four languages of the corpus.
BOILERPLATE = (
    "all rights reserved",
    "accept cookies",
    "cookie policy",
    "uses cookies",
    "privacy policy",
    "terms of use",
    "terms of service",
    "enable javascript",
    "javascript is disabled",
    "subscribe to our newsletter",
    "sign up for our",
    "click here to",
    "share on facebook",
    "share on twitter",
    "skip to content",
    "lorem ipsum",
    "alle rechte vorbehalten",
    "cookies akzeptieren",
    "verwendet cookies",
    "datenschutzerkl",
    "nutzungsbedingungen",
    "newsletter abonnieren",
    "zum inhalt springen",
    "javascript aktivieren",
    "tous droits réservés",
    "accepter les cookies",
    "utilise des cookies",
    "politique de confidentialité",
    "conditions d'utilisation",
    "abonnez-vous à notre newsletter",
    "aller au contenu",
    "activer javascript",
    "todos los derechos reservados",
    "aceptar las cookies",
    "utiliza cookies",
    "política de privacidad",
    "condiciones de uso",
    "suscríbete a nuestro boletín",
    "ir al contenido",
    "habilitar javascript",
)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
#: Characters that end a line like a sentence: marks, closing quotes and brackets, of all scripts in use.
ENDS = (".", "!", "?", ":", ";", ",", '"', "'", ")", "]", "\u2026", "\u201d", "\u2019", "\u00bb", "\u3002", "\u3001", "\uff1f", "\uff01")


def _ends_well(raw: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether the character whose last byte is at each place is one of ``ENDS``."""
    out = np.zeros(len(last), bool)
    for end in (e.encode() for e in ENDS):
        same = last >= len(end) - 1
        for k, byte in enumerate(reversed(end)):
            same &= raw[np.maximum(last - k, 0)] == byte
        out |= same
    return out


def _latin_capitals(raw: np.ndarray) -> np.ndarray:
    """Second bytes of \u00c0 to \u00de, without the multiplication sign."""
    out = np.zeros(len(raw), bool)
    out[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
    return out


@dataclass(frozen=True)
class LineRules:
    min_words: int = 20
    max_repeat_pct: int = 30
    window: int = 8
    max_loss_pct: int = 50
    symbols_per_word: float = 0.5
    bars_per_word: float = 0.2
    upper_share: float = 0.5
    adjacent_repeats: float = 0.4
    min_line_words: int = 4
    prose_words: int = 12


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_words", "n_failed_lines")
SCHEMA = ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, clean_text string"


def _repeat_words(chunk, window: int) -> np.ndarray:
    """Per document the words inside windows that the same document holds twice or more."""
    at, hashes = chunk.rolling(window)
    if not len(at):
        return np.zeros(chunk.n, np.int64)
    order = np.lexsort((hashes, chunk.doc[at]))
    h, d = hashes[order], chunk.doc[at][order]
    same = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
    again = np.zeros(len(at), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    edge = np.zeros(len(chunk.starts) + 1, np.int64)
    np.add.at(edge, at[again], 1)
    np.add.at(edge, at[again] + window, -1)
    return per_doc(np.cumsum(edge)[:-1] > 0, chunk.word_offsets)


def _places(text: bytes) -> np.ndarray:
    """First and last byte of every phrase in the text."""
    out = []
    for phrase in (p.encode() for p in BOILERPLATE):
        at = text.find(phrase)
        while at >= 0:
            out.append((at, at + len(phrase) - 1))
            at = text.find(phrase, at + 1)
    return np.array(out, np.int64).reshape(-1, 2)


def judge(chunk, rules: LineRules) -> dict[str, np.ndarray]:
    """Counts, verdicts and the failing lines of a chunk of documents."""
    out = {
        "n_words": chunk.n_words,
        "word_chars": per_doc(chunk.nonspace & ((chunk.raw & 0xC0) != 0x80), chunk.offsets),
        "n_symbols": per_doc(_SYMBOL[chunk.raw], chunk.offsets),
        "n_repeat_words": _repeat_words(chunk, rules.window),
    }
    starts, ends, doc = chunk.lines()
    hashes = chunk.hashes()
    line_of_word = np.searchsorted(starts, chunk.starts, side="right") - 1
    words = np.bincount(line_of_word, minlength=len(starts))
    full = words > 0
    whole = spans_hash(chunk.raw.astype(np.uint64) + np.uint64(1), starts[full], ends[full])
    order = np.lexsort((np.arange(len(whole)), whole, doc[full]))
    copies = np.zeros(len(whole), bool)
    copies[order[1:]] = (whole[order[1:]] == whole[order[:-1]]) & (doc[full][order[1:]] == doc[full][order[:-1]])
    out["n_dup_lines"] = np.bincount(doc[full][copies], minlength=chunk.n)

    def count(bytes_: np.ndarray) -> np.ndarray:
        return np.bincount(np.searchsorted(starts, np.flatnonzero(bytes_), side="right") - 1, minlength=len(starts))

    letters = np.bincount(line_of_word, weights=chunk.ends - chunk.starts, minlength=len(starts))
    latin = _latin_capitals(chunk.raw)
    capitals = count(_UPPER[chunk.raw]) + 2 * count(latin)
    long = words >= rules.min_line_words
    twice = np.zeros(len(hashes), bool)
    twice[1:] = (hashes[1:] == hashes[:-1]) & (line_of_word[1:] == line_of_word[:-1])
    last = np.zeros(len(starts), np.int64)
    last[line_of_word] = chunk.ends - 1
    furniture = np.zeros(len(starts), bool)
    text = chunk.raw.tobytes()
    folded = (chunk.raw + 32 * (latin | _UPPER[chunk.raw])).astype(np.uint8).tobytes()
    first, last_byte = (np.searchsorted(starts, x, side="right") - 1 for x in _places(folded).T)
    furniture[first[first == last_byte]] = True  # the bytes of two documents that meet make no phrase
    failed = full & (
        furniture
        | (count(_SYMBOL[chunk.raw]) > rules.symbols_per_word * words)
        | (count(chunk.raw == ord("|")) > rules.bars_per_word * words)
        | (long & (capitals > rules.upper_share * letters))
        | (long & (np.bincount(line_of_word[twice], minlength=len(starts)) > rules.adjacent_repeats * words))
        | (~_ends_well(chunk.raw, last) & (words < rules.prose_words))
    ) if len(chunk.raw) else full
    out["n_lost_words"] = np.bincount(doc, weights=words * failed, minlength=chunk.n).astype(np.int64)
    out["n_failed_lines"] = np.bincount(doc, weights=failed, minlength=chunk.n).astype(np.int64)
    out["base_failed"] = (out["n_words"] < rules.min_words) | (100 * out["n_repeat_words"] > rules.max_repeat_pct * out["n_words"])
    out["kept"] = ~out["base_failed"] & (100 * out["n_lost_words"] <= rules.max_loss_pct * out["n_words"])
    kept_lines = np.split(np.flatnonzero(~failed), np.cumsum(np.bincount(doc[~failed], minlength=chunk.n))[:-1])
    out["clean_text"] = [
        text[chunk.offsets[i] : chunk.offsets[i + 1]].decode() if not out["n_failed_lines"][i]
        else b"\n".join(text[starts[k] : ends[k]] for k in kept_lines[i]).decode()
        for i in range(chunk.n)
    ]
    return out


def clean_lines(docs: DataFrame, rules: LineRules = LineRules(), text: str = "text", carry: tuple[str, ...] = ("doc_id",), with_text: bool = True) -> DataFrame:
    """``carry`` columns, the counts, ``base_failed``, ``kept`` and, if asked for, ``clean_text``."""
    names = [c for c in SCHEMA.replace(",", "").split()[::2] if with_text or c != "clean_text"]
    kinds = dict(x.split() for x in SCHEMA.split(", "))
    carried = [c for c in carry if c not in names]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried] + [f"{c} {kinds[c]}" for c in names])

    def run(batches):
        for batch in batches:
            for row, chunk in chunks(batch, text):
                got = judge(chunk, rules)
                own = [batch.column(batch.schema.get_field_index(c)).slice(row, chunk.n) for c in carried]
                yield pa.RecordBatch.from_arrays(own + [pa.array(got[c]) for c in names], names=[*carried, *names])

    return map_batches(docs.select(*carried, *[c for c in (text,) if c not in carried]), run, schema)
