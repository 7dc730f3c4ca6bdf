"""One consistent form of texts that look the same.

Only segments that fail a quick check are normalized. ASCII is stable, and so is a text or a word that
has the quick-check property of its composed form and no letter of a second script; what is left is
put into canonical form word by word, with the word's own boundaries as context, and spliced back into
the unchanged rest.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelake.operators.dedupe import latest

# Letters of other scripts that look like Latin ones, then the Latin letters.
_CYRILLIC = "АВЕЅІЈКМНОРСТУХҮԌаеѕіјорсухһԁԛԝѵ"
_CYRILLIC_LATIN = "ABESIJKMHOPCTYXYGaesijopcyxhdqwv"
_GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳ"
_GREEK_LATIN = "ABEZHIKMNOPTYXovcj"
_TO_LATIN = str.maketrans(_CYRILLIC + _GREEK, _CYRILLIC_LATIN + _GREEK_LATIN)
_TO_CYRILLIC = str.maketrans(dict(zip(_CYRILLIC_LATIN[::-1], _CYRILLIC[::-1])))
_TO_GREEK = str.maketrans(dict(zip(_GREEK_LATIN[::-1], _GREEK[::-1])))
_LOOKALIKE = frozenset(_CYRILLIC + _GREEK + _CYRILLIC_LATIN + _GREEK_LATIN)

#: Invisible characters: format controls, joiners, fillers, variation selectors, tags.
_INVISIBLE = [0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, 0x3164, 0xFEFF, 0xFFA0, *range(0x180B, 0x180E), *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), 0xE0001, *range(0xE0020, 0xE0080), *range(0xE0100, 0xE01F0)]
_SPACES = [0x9, 0xA, 0xB, 0xC, 0xD, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_HYPHENS = [0x2010, 0x2011, 0xFE63]


def _plain() -> dict[int, str]:
    """Code points that stand for other text whatever is around them."""
    table = {c: "" for c in _INVISIBLE} | {c: " " for c in _SPACES} | {c: "-" for c in _HYPHENS}
    for c in [*range(0xFB00, 0xFB50), *range(0xFF01, 0xFFEF), 0x132, 0x133, 0x1C7, 0x1C8, 0x1C9, 0x1CA, 0x1CB, 0x1CC, 0x1F1, 0x1F2, 0x1F3]:
        how = unicodedata.decomposition(chr(c)).split(" ")[0]
        if how in ("<wide>", "<narrow>") or how == "<compat>" and (c < 0xFB20 or c == 0xFB4F or c < 0x200):
            table.setdefault(c, unicodedata.normalize("NFKC", chr(c)))
    return table


_PLAIN = _plain()
_UNSTABLE = frozenset(map(chr, _PLAIN))
_WORD = re.compile(r"[^\s]*[^\x00-\x7f][^\s]*")
_RUN = re.compile(r"[^\W\d_](?:[^\W\d_]|[̀-ͯ])*")


#: Per script the tables that bring its look-alikes home: first the third script's to Latin, then all to it.
_TABLES = {"latin": (_TO_LATIN, None), "cyrillic": (str.maketrans(_GREEK, _GREEK_LATIN), _TO_CYRILLIC), "greek": (str.maketrans(_CYRILLIC, _CYRILLIC_LATIN), _TO_GREEK)}


def _script(run: str) -> str:
    """The script of a run's letters that are no look-alikes; Latin where there are none or several."""
    scripts = set()
    for ch in run:
        if ch in _LOOKALIKE or not ch.isalpha():
            continue
        code = ord(ch)
        scripts.add("cyrillic" if 0x400 <= code < 0x530 else "greek" if 0x370 <= code < 0x400 else "latin")
    return scripts.pop() if len(scripts) == 1 else "latin"


def _run(match: re.Match) -> str:
    run = match.group()
    if run.isascii():
        return run
    first, then = _TABLES[_script(run)]
    return run.translate(first).translate(then) if then else run.translate(first)


#: Characters of runs that may be of another script: look-alikes, those with accents, too, and accents.
_NOT_TELLING = _LOOKALIKE | {chr(c) for c in range(0x300, 0x530) if c < 0x370 or unicodedata.normalize("NFD", chr(c))[0] in _LOOKALIKE}
#: Letters of the scripts that look-alikes come from.
_OTHER_SCRIPT = re.compile(r"[\u0370-\u03ff\u0400-\u052f]")
#: Words of one script whose letters can't be taken for another's: Cyrillic or Greek without Latin and the other one.
_ONE_SCRIPT = re.compile(r"[\u0400-\u052f\W\d_]*|[\u0370-\u03ff\W\d_]*")


def stable(segment: str) -> bool:
    """The quick check: whether a segment without plain replacements is surely canonical already."""
    if not unicodedata.is_normalized("NFC", segment):
        return False
    if not _OTHER_SCRIPT.search(segment):
        return True
    # one script throughout, each run with a letter that only this script has
    return _ONE_SCRIPT.fullmatch(segment) is not None and all(not _NOT_TELLING.issuperset(run) for run in _RUN.findall(segment))


def _canonical_word(word: str) -> str:
    """The canonical form of one segment: letters of one script, accents composed."""
    return word if stable(word) else unicodedata.normalize("NFC", _RUN.sub(_run, unicodedata.normalize("NFD", word)))


_known_word = functools.lru_cache(maxsize=1 << 16)(_canonical_word)


def _word(match: re.Match) -> str:
    word = match.group()
    return _known_word(word) if len(word) <= 64 else _canonical_word(word)


def canonical(text: str | None) -> str | None:
    """The one form of all texts that look like ``text``; null for null, empty for empty.

    Widths and ligatures, composed or combining accents, invisible characters, kinds of spaces and
    hyphens and letters of other scripts are made one. What a reader can see stays: case, accents,
    superscripts, symbols, fractions, dashes, punctuation and the number of spaces. Look-alike
    letters take the script of the other letters of their run; a run of only look-alikes is Latin.
    """
    if text is None or text.isascii() and text.isprintable():
        return text
    if not _UNSTABLE.isdisjoint(text):
        text = text.translate(_PLAIN)
    if text.isascii() or not _OTHER_SCRIPT.search(text) and unicodedata.is_normalized("NFC", text):
        return text
    return _WORD.sub(_word, text)


def canonical_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Appends column ``canonical`` of the batch's last column."""
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        forms = pa.array([canonical(t) for t in texts.to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns, forms], names=[*batch.schema.names, "canonical"])


def needs_check(column: str):
    """Whether a text may be unstable (JVM side quick check)."""
    return F.col(column).rlike(r"[^\x20-\x7E]")


def with_canonical(df: DataFrame, text: str, to: str = "canonical") -> DataFrame:
    """``df`` with the canonical form of column ``text``; only rows that fail the quick check go to Python."""
    stable = df.filter(F.coalesce(~needs_check(text), F.lit(True))).withColumn(to, F.col(text))
    order = [c for c in df.columns if c != text]
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    ddl = ", ".join([*(f"`{c}` {fields[c]}" for c in order), f"`{text}` string", "canonical string"])
    checked = df.filter(needs_check(text)).select(*order, text).mapInArrow(canonical_batches, ddl).withColumnRenamed("canonical", to)
    return stable.unionByName(checked)


def lookalike_pairs(elements: DataFrame, key: str = "element_key", page: str = "page_id", fields: tuple[str, ...] = ("text", "label")) -> DataFrame:
    """(element_key_a, element_key_b, field): elements of a page whose field looks equal but isn't.

    Of two such strings at least one differs from the canonical form, so all rows are joined with
    those few only, by page, field and digest of the form; no group is collected. Redelivered rows
    count once, nulls and empty strings never; pairs have the smaller key first.
    """
    received = F.col("received_at") if "received_at" in elements.columns else F.lit(None).cast("timestamp")
    values = elements.select(F.col(key).cast("bigint").alias("k"), F.col(page).alias("page"), received.alias("r"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("v")) for f in fields))).alias("x"))
    values = values.select("k", "page", "r", "x.field", F.col("x.v").alias("value")).filter("k is not null and page is not null and value <> ''")
    forms = with_canonical(values, "value")
    slim = forms.select("k", "page", "r", "field", F.unhex(F.md5("value")).alias("v"), F.unhex(F.md5("canonical")).alias("c"))
    slim = latest(slim, ["k", "field"], ["r"]).select("k", "page", "field", "v", "c")
    changed = slim.filter("v <> c")
    on = (F.col("a.page") == F.col("b.page")) & (F.col("a.field") == F.col("b.field")) & (F.col("a.c") == F.col("b.c")) & (F.col("a.v") != F.col("b.v"))
    once = (F.col("a.v") == F.col("a.c")) | (F.col("a.k") < F.col("b.k"))
    pairs = slim.alias("a").join(changed.alias("b"), on & once & (F.col("a.k") != F.col("b.k")))
    return pairs.select(F.least("a.k", "b.k").alias("element_key_a"), F.greatest("a.k", "b.k").alias("element_key_b"), F.col("a.field").alias("field"))
