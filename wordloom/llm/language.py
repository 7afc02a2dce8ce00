"""Language of documents and of the stretches in them.

Every sentence of every text is coded with the frozen byte-level PPM models of
:mod:`.ppm`, one per language; the shortest code names the language.  Adjacent
sentences of one language form a span.  The models come from labelled sentences,
and optionally from a bounded sample of labelled documents whose sentences the
first models largely confirm.

Nulls and empty texts, and texts without a sentence (formulas, headings, names),
have no spans; a text without spans has a language over all its letters, if its codes
differ enough.  Rows are independent: repeated rows repeat their result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ppm import PPM, fold

SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("lang", T.StringType()),
            T.StructField("confidence", T.DoubleType()),
            T.StructField("sentences", T.IntegerType()),
        ]
    )
)

# ISO 639-2/3 codes and names in use beside the two-letter codes.
_OTHER_NAMES = {
    "en": "eng english",
    "de": "deu ger german deutsch",
    "fr": "fra fre french francais français",
    "es": "spa spanish espanol español castellano",
    "pt": "por portuguese portugues português",
    "nl": "nld dut dutch nederlands",
    "ru": "rus russian русский",
    "zh": "zho chi cmn chinese 中文 汉语",
}

SENTENCE_BYTES = 8  # least bytes of letters in a sentence
SENTENCE_BLANKS = 2  # least blanks in a sentence of a script that writes them
# Full stop and marks of full width; opening and closing quotation marks and brackets.
_WIDE_STOPS = ("。".encode(), "！".encode(), "？".encode())
_OPENING_2, _OPENING_3 = ("«".encode(),), tuple(c.encode() for c in "“„‘‹「『")
_CLOSING_2 = ("»".encode(),)
_CLOSING_3 = tuple(c.encode() for c in "”’“‘›」』）")
MOST_BITS = 8.0  # a sentence that no model codes better than plain bytes is in no known language
WELL_CODED = 5.2  # bits per byte up to which a sentence is in the models' own words; beyond,
CLEAR_MARGIN = 2.0  # the best code must beat the next by so many bits per byte
LEAST_MARGIN = 10.0  # bits by which the best code must beat the next
TEMPER = 8.0  # bits of evidence that count as one: neighbouring bytes are not independent
TOLERANCE = 40.0  # bits by which another language may code a sentence of a fitting document better
CHUNK = 1 << 20  # bytes of text scored at once


def language_code(label: Column) -> Column:
    """Two-letter code of a label in any usual writing (``EN``, ``en_US``, ``eng``,
    ``English``); of a language without models, a two-letter code is taken as it is.  Any
    other label, empty or null gives null."""
    names = {n: code for code, other in _OTHER_NAMES.items() for n in [code, *other.split()]}
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    head = F.regexp_extract(F.lower(F.trim(label)), r"^([^-_ .@/]+)", 1)
    return F.coalesce(F.try_element_at(table, head), F.when(head.rlike("^[a-z]{2}$"), head))


def _sequence(data: np.ndarray, *sequences: bytes) -> np.ndarray:
    """Where each byte belongs to one of the byte sequences (of one length)."""
    size = len(sequences[0])
    hit = np.zeros(len(data), bool)
    last = np.flatnonzero(np.isin(data, [q[-1] for q in sequences]))
    last = last[last >= size - 1]
    for q in sequences:
        ok = np.ones(len(last), bool)
        for j, byte in enumerate(q):
            ok &= data[last - size + 1 + j] == byte
        for j in range(size):
            hit[last[ok] - j] = True
    return hit


def _segments(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends of the sentence-like pieces of folded bytes (8 pad bytes first),
    and whether each is a whole sentence."""
    n = len(data)
    wide = np.zeros(n, bool)
    for q in _WIDE_STOPS:
        at = np.flatnonzero(data[2:] == q[2]) + 2
        wide[at[(data[at - 2] == q[0]) & (data[at - 1] == q[1])]] = True
    stop = (data == 46) | (data == 33) | (data == 63) | wide
    # closing quotation marks and brackets after a mark belong to its sentence
    closing = (data == 34) | (data == 39) | (data == 41) | (data == 93) | _sequence(data, *_CLOSING_2) | _sequence(data, *_CLOSING_3)
    open_end = np.append(np.flatnonzero(~closing), n)
    marks = np.flatnonzero(stop)
    after = open_end[np.searchsorted(open_end, marks + 1)]
    follow = np.append(data, np.uint8(10))[after]
    # a mark ends a sentence before a blank, a line end, an opening bracket, or a script without
    # blanks; after an abbreviation a number goes on (digits are folded to 0)
    number = (follow == 32) & (np.append(data, [np.uint8(10)] * 2)[np.minimum(after + 1, n)] == 48) & (data[marks] == 46)
    good = wide[marks] | (follow == 10) | (follow == 40) | (follow == 91) | ((follow == 32) & ~number) | ((follow >= 0xE3) & (follow <= 0xE9))
    stopped = np.zeros(n, bool)
    stopped[after[good] - 1] = True
    dense_stop = np.zeros(n, bool)
    dense_stop[after[wide[marks]] - 1] = True
    cut = (data == 10) | stopped
    cut[:8] = False
    cut[7] = True
    cut[-1] = True
    ends = np.flatnonzero(cut)[1:] + 1
    starts = np.concatenate([[8], ends[:-1]])
    # leave out the blanks and opening quotation marks before a piece
    keep = ends > starts
    starts, ends = starts[keep], ends[keep]
    lead = (data == 32) | (data == 10) | (data == 34) | (data == 39) | _sequence(data, *_OPENING_2) | _sequence(data, *_OPENING_3)
    ahead = np.flatnonzero(~lead)
    pos = np.searchsorted(ahead, starts)
    starts = np.where(pos < len(ahead), ahead[np.minimum(pos, len(ahead) - 1)] if len(ahead) else starts, ends)
    ok = starts < ends
    starts, ends = starts[ok], ends[ok]
    if not len(starts):
        return starts, ends, np.zeros(0, bool)
    run = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    letters, blanks, high = run((data >= 97) & (data <= 122) | (data >= 128)), run(data == 32), run(data >= 0xE3)
    n_letters, n_blanks, n_high = (x[ends] - x[starts] for x in (letters, blanks, high))
    size = ends - starts

    def unclosed(left: int, right: int) -> np.ndarray:
        """Whether a bracket is opened last and not closed: the piece breaks off in it."""
        place = np.arange(n)
        last = lambda byte: np.maximum.accumulate(np.where(data == byte, place, -1))[ends - 1]
        return last(left) >= np.maximum(starts, last(right) + 1)

    spaced = stopped[ends - 1] & (n_blanks >= SENTENCE_BLANKS)
    dense = (stopped | dense_stop)[ends - 1] & (n_high >= 5)
    whole = (spaced | dense) & (n_letters >= SENTENCE_BYTES) & (n_letters * 2 > size) & ~unclosed(40, 41) & ~unclosed(91, 93)
    return starts, ends, whole


def _lowered(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def score_texts(model: PPM, texts: list[str | None]) -> Iterator[list[dict]]:
    """The spans of each text, as dicts with the fields of ``SPANS``."""
    return (spans for spans, _ in score_documents(model, texts))


def score_documents(model: PPM, texts: list[str | None]) -> Iterator[tuple[list[dict], dict | None]]:
    """The spans of each text, and its language as a whole (lang, confidence)."""
    gap = b"\n" * 8
    begin = 0
    while begin < len(texts):
        parts, bounds, size, end = [gap], [], 8, begin
        while end < len(texts) and (end == begin or size < CHUNK):
            raw = _lowered(texts[end]).encode("utf-8", "replace") if texts[end] else b""
            bounds.append(size)
            parts += [raw, gap]
            size += len(raw) + 8
            end += 1
        yield from _score(model, np.frombuffer(fold(b"".join(parts)), np.uint8), np.array(bounds + [size]))
        begin = end


def _decided(bits: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By row: the best language, whether it is sure enough, and how sure."""
    order = np.argsort(bits, axis=1, kind="stable")
    best = order[:, 0]
    rows = np.arange(len(best))
    low = bits[rows, best]
    margin = bits[rows, order[:, 1]] - low if bits.shape[1] > 1 else np.full(len(best), np.inf)
    sure = 1.0 / np.exp2(-(bits - low[:, None]) / TEMPER).sum(axis=1)
    clear = (low <= WELL_CODED * size) | (margin >= CLEAR_MARGIN * size)
    return best, (margin >= LEAST_MARGIN) & clear & (low <= MOST_BITS * size) & (size > 0), sure


def _score(model: PPM, data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[list[dict], dict | None]]:
    starts, ends, whole = _segments(data)
    found: list[list[dict]] = [[] for _ in range(len(bounds) - 1)]
    overall: list[dict | None] = [None] * len(found)
    if len(starts) and model.langs:
        # pieces and the gaps between them alternate; only the pieces count
        marks = np.unique(np.concatenate([starts, ends[ends < len(data)]]))
        bits = model.code_lengths(data, marks)[np.searchsorted(marks, starts)]
        best, good, sure = _decided(bits, ends - starts)
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        doc = np.searchsorted(bounds, starts, side="right") - 1
        for j in np.flatnonzero(whole & good).tolist():
            d = int(doc[j])
            base = chars[bounds[d]]
            spans, lang = found[d], model.langs[best[j]]
            s, e = int(chars[starts[j]] - base), int(chars[ends[j]] - base)
            if spans and spans[-1]["lang"] == lang:
                last = spans[-1]
                n = last["sentences"]
                last["confidence"] = (last["confidence"] * n + float(sure[j])) / (n + 1)
                last["end"], last["sentences"] = e, n + 1
            else:
                spans.append({"start": s, "end": e, "lang": lang, "confidence": float(sure[j]), "sentences": 1})
        sums = np.zeros((len(found), len(model.langs)))
        np.add.at(sums, doc, bits)
        best, good, sure = _decided(sums, np.bincount(doc, weights=ends - starts, minlength=len(found)))
        for d in np.flatnonzero(good).tolist():
            overall[d] = {"lang": model.langs[best[d]], "confidence": float(sure[d])}
    yield from zip(found, overall)


def fit_languages(samples: DataFrame, order: int = 5) -> PPM:
    """Models from labelled sentences (``lang``, ``sentence``): a table of bounded size.
    Rows with a null or empty side are left out."""
    by: dict[str, list[str]] = {}
    for row in samples.select("lang", "sentence").where("length(lang) > 0 and length(sentence) > 0").collect():
        by.setdefault(row[0], []).append(row[1])
    return PPM({k: sorted(v) for k, v in by.items()}, order)


def refit_with_documents(model: PPM, samples: DataFrame, documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_language: int = 40, sample_bytes: int = 60_000) -> PPM:
    """Models that also know a bounded sample of labelled documents.

    Of each language the ``per_language`` documents with the least hash of their id
    are taken, at most ``sample_bytes`` bytes of sentences each language (and document).
    A document counts if the first models find its label in most of its sentences; of it,
    the sentences count for which the labelled language is best or second best.

    Two passes: one over ids and labels, which keeps the least hashes on the map side, one
    over the chosen documents.  Executors cut the sentences out; only those are collected.
    """
    code = language_code(F.col(label_col))
    labelled = documents.select(F.col(id_col).alias("id"), code.alias("code")).where(F.col("code").isin(model.langs) & F.col("id").isNotNull())
    place = F.row_number().over(Window.partitionBy("code").orderBy(F.xxhash64("id"), "id"))
    wanted = {(r["code"], r["id"]) for r in labelled.withColumn("place", place).where(F.col("place") <= per_language).collect()}
    by: dict[str, list[str]] = {}
    for row in samples.select("lang", "sentence").where("length(lang) > 0 and length(sentence) > 0").collect():
        by.setdefault(row[0], []).append(row[1])
    if wanted:
        chosen = documents.where(F.col(id_col).isin([i for _, i in wanted])).select(F.col(id_col).alias("id"), code.alias("code"), F.col(text_col).cast("string").alias("text")).where("length(text) > 0")

        tolerance = TOLERANCE

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(i, c, _sure_sentences(model, t, model.langs.index(c), sample_bytes, tolerance)) for i, c, t in zip(*(x.to_pylist() for x in batch.columns)) if (c, i) in wanted]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch.column(0).type), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.list_(pa.string()))], names=["id", "code", "sentences"])

        schema = T.StructType([chosen.schema["id"], T.StructField("code", T.StringType()), T.StructField("sentences", T.ArrayType(T.StringType()))])
        used = dict.fromkeys(model.langs, 0)
        for row in sorted(chosen.mapInArrow(run, schema).collect(), key=lambda r: (r["id"], r["sentences"])):
            for sentence in row["sentences"]:
                if used[row["code"]] <= sample_bytes:
                    by.setdefault(row["code"], []).append(sentence)
                    used[row["code"]] += len(sentence)
    return PPM(by, model.order)


def _sure_sentences(model: PPM, text: str, lang: int, most: int, tolerance: float) -> list[str]:
    """The sentences of a labelled document that the models allow its language, up to
    ``most`` bytes; none if they find another language in most of them."""
    data = np.frombuffer(fold(b"\n" * 8 + _lowered(text).encode("utf-8", "replace") + b"\n" * 8), np.uint8)
    starts, ends, whole = _segments(data)
    if not whole.any():
        return []
    marks = np.unique(np.concatenate([starts, ends[ends < len(data)]]))
    bits = model.code_lengths(data, marks)[np.searchsorted(marks, starts)]
    rank = np.argsort(bits, axis=1)
    if (rank[whole, 0] == lang).mean() < 0.6:
        return []
    out, used = [], 0
    for j in np.flatnonzero(whole & ((rank[:, :2] == lang).any(axis=1))):
        if bits[j, lang] - bits[j, rank[j, 0]] > tolerance or used > most:
            continue
        sentence = data[starts[j] : ends[j]].tobytes()
        out.append(sentence.decode("utf-8", "replace"))
        used += len(sentence)
    return out


def label_spans(documents: DataFrame, model: PPM, *, text_col: str = "text", keep: list[str] | None = None, overall: bool = False) -> DataFrame:
    """One row per document: the columns ``keep`` and ``spans``, an array of
    (start, end in code points, lang, confidence, sentences) in text order; with ``overall``
    also the language of the text as a whole, struct<lang, confidence>, null if unsure.

    Runs map-side, without a shuffle.  The models travel with the tasks; their size
    is bounded by the bounded samples they were fitted on.  By default all columns are
    kept but the text and any named like an output.  Without languages there are no spans.
    """
    outputs = ["spans", *(["overall"] if overall else [])]
    keep = keep if keep is not None else [c for c in documents.columns if c not in (text_col, *outputs)]
    src = documents.select(*keep, F.col(text_col).cast("string").alias("__text"))
    whole = T.StructType([T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType())])
    schema = T.StructType([src.schema[c] for c in keep] + [T.StructField("spans", SPANS)] + [T.StructField("overall", whole)] * overall)
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("sentences", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep))
            for at in range(0, max(1, batch.num_rows), 256):
                part = batch.slice(at, 256)
                got = list(score_documents(model, texts.slice(at, 256).to_pylist()))
                made = [pa.array([g[0] for g in got], spans_type)]
                if overall:
                    made.append(pa.array([g[1] for g in got], pa.struct([("lang", pa.string()), ("confidence", pa.float64())])))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=[*keep, *outputs])

    return src.mapInArrow(run, schema)


def document_language(labelled: DataFrame) -> DataFrame:
    """Adds ``main_lang`` (of the most sentences; ties: first in the alphabet) and
    ``main_confidence`` (its share of sentences times its mean confidence) to the
    result of :func:`label_spans`.  Where there is no span they are those of the text as a
    whole, if the result has them, else null."""
    total = F.expr("aggregate(spans, 0, (a, x) -> a + x.sentences)")
    per = F.expr(
        """transform(array_distinct(transform(spans, x -> x.lang)), l -> struct(
             aggregate(filter(spans, x -> x.lang = l), 0, (a, x) -> a + x.sentences) as n, l as lang,
             aggregate(filter(spans, x -> x.lang = l), 0D, (a, x) -> a + x.sentences * x.confidence) as c))"""
    )
    best = F.expr("array_sort(__per, (a, b) -> case when a.n <> b.n then b.n - a.n when a.lang < b.lang then -1 when a.lang > b.lang then 1 else 0 end)")
    spare = [F.col("overall.lang"), F.col("overall.confidence")] if "overall" in labelled.columns else [F.lit(None).cast("string"), F.lit(None).cast("double")]
    return (
        labelled.withColumn("__per", per)
        .withColumn("__best", F.get(best, F.lit(0)))
        .withColumn("main_lang", F.coalesce("__best.lang", spare[0]))
        .withColumn("main_confidence", F.coalesce(F.col("__best.c") / F.nullif(total, F.lit(0)), spare[1]))
        .drop("__per", "__best")
    )


def missing_languages(labelled: DataFrame, *, id_col: str = "doc_id", label_col: str = "lang") -> DataFrame:
    """(id, lang): the languages with a whole sentence that the label does not name."""
    named = F.coalesce(language_code(F.col(label_col)), F.lit(""))
    langs = F.array_distinct(F.transform("spans", lambda x: x["lang"]))
    return labelled.select(F.col(id_col), F.explode(F.filter(langs, lambda l: l != named)).alias("lang"))
