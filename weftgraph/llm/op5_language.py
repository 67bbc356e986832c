"""Language identification by compression.

Each language has a raw-content zstandard dictionary made of training texts. A text
is lower-cased, what is not a letter becomes a space, and the whole of it is compressed
with every dictionary, in blocks so short that the dictionary counts for more than
repetition inside the text. The dictionary that makes it smallest names the
language. A text is rejected, at any length, unless the lesser of two shares is above a
learned least: the margin to the second language, and what the best dictionary saves
against no dictionary. Ties, null texts and texts without letters (und) are always rejected. The
least is the value that best parts training texts identified rightly from those
that can not be (language without a dictionary, random letters, wrong answers), and of which at most a share of LOST of the
texts identified rightly is rejected, all measured with dictionaries of other training texts.

The dictionaries are fitted on a bounded sample: of each language at most
SAMPLE_DOCS texts of at most SAMPLE_CHARS characters, chosen by a hash of doc_id,
and of those what fits into DICT_BYTES. Rows with null doc_id, text or lang are not
learned from. Without any training text every prediction is und. Each row gives
one row, repeated rows and null ids too (null ids are not held out); an empty table gives an empty result; other columns are ignored
by predict and kept by keep_identified. Long texts are compressed whole. Of equally small sizes the first language by name is predicted, and rejected.
Only letters count: ASCII and other ones alike, so dashes, digits and emoji do not tell a language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_DOCS = 400
SAMPLE_CHARS = 20_000
DICT_BYTES = 100_000
LEVEL = 6
BLOCK = 1 << 10
#: Training texts of each language and fold from which the least evidence is learned.
FOLD_TEXTS = 200
#: Share of rightly identified training texts that the least evidence may reject.
LOST = 0.005
SEED = 5
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_LETTER = regex.compile(r"\p{L}")
#: What is neither ASCII nor a letter or a mark.
_OTHER = regex.compile(r"[^\p{L}\p{M}\x00-\x7F]+")


def normal(text: str) -> bytes:
    low = text.lower()
    if not low.isascii():
        low = _OTHER.sub(" ", low)
    return b" ".join(low.encode("utf-8", "replace").translate(_LETTERS).split())


def held_out(doc_id: Column, of: int = 5, part: int = 0) -> Column:
    """Whether crc32 of the id as text leaves that remainder; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of == part, F.lit(False))


class Model(dict):
    """Language -> dictionary content; a text is rejected unless its evidence is above least."""

    least = 0.0


def _dictionary(texts: list[bytes]) -> bytes:
    out = b""
    for t in texts:
        if len(out) >= DICT_BYTES:
            break
        out += t + b" "
    return out[:DICT_BYTES]


def _sizes(raw: bytes, tools) -> np.ndarray:
    """Compressed bytes with each of tools."""
    blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
    return np.array([sum(len(t.compress(b)) for b in blocks) for t in tools], float)


def evidence(size: np.ndarray, plain: float) -> tuple[float, float]:
    """The margin to the second language, and the lesser of it and of what the best
    dictionary saves, both as shares of compressed bytes. 0 for ties, 1 the margin of a single language."""
    k = int(size.argmin())
    rest = np.delete(size, k)
    margin = float((rest.min() - size[k]) / max(1.0, size[k])) if len(rest) else 1.0
    return margin, min(margin, float((plain - size[k]) / max(1.0, plain)))


def _least(texts: dict[str, list[bytes]]) -> float:
    """The evidence that best parts texts that are identified rightly from those that can not be: texts
    whose language has no dictionary, random letters and wrong answers. Texts are measured with dictionaries of the other fold."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    names = sorted(texts)
    good, bad = [], []
    for fold in range(2):
        content = [_dictionary(texts[a][1 - fold :: 2]) for a in names]
        if any(len(c) < 8 for c in content):
            continue
        tools = [*_compressors(dict(zip(names, content, strict=True))), _plain()]
        for i, a in enumerate(names):
            for raw in texts[a][fold::2][:FOLD_TEXTS]:
                *size, plain = _sizes(raw, tools)
                size = np.array(size)
                known = evidence(size, plain)[1]
                (good if known > 0 and size.argmin() == i else bad).append(known)
                if len(names) > 1:
                    bad.append(evidence(np.delete(size, i), plain)[1])
                noise = bytes(b if b == 32 else x for b, x in zip(raw, rng.integers(97, 123, len(raw)).tolist(), strict=True))
                *size, plain = _sizes(noise, tools)
                bad.append(evidence(np.array(size), plain)[1])
    if not good or not bad:
        return 0.0
    good, bad = np.sort(good), np.sort(bad)
    tried = np.unique(np.maximum(0.0, np.concatenate(([0.0], bad))))
    lost = np.searchsorted(good, tried, "right") / len(good)  # none at 0
    tried, lost = tried[lost <= LOST], lost[lost <= LOST]
    return float(tried[(lost - np.searchsorted(bad, tried, "right") / len(bad)).argmin()])


def fit(docs: DataFrame) -> Model:
    """Dictionaries and least evidence, from rows with doc_id, text and lang."""
    known = docs.where("doc_id is not null and text is not null and lang is not null").select("doc_id", "text", "lang")
    known = known.where(F.length("text") <= SAMPLE_CHARS)
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return Model()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    chosen = F.lit(False)
    for lang, n in counts.items():
        chosen = chosen | ((F.col("lang") == lang) & (place < min(1 << 30, (2 * SAMPLE_DOCS << 30) // n)))
    rows = sorted(known.where(chosen).select("lang", place.alias("place"), "doc_id", "text").collect())
    texts: dict[str, list[bytes]] = {}
    for r in rows:
        if len(own := texts.setdefault(r.lang, [])) < SAMPLE_DOCS:
            own.append(normal(r.text))
    out = {k: _dictionary(v) for k, v in sorted(texts.items())}
    model = Model({k: v for k, v in out.items() if len(v) >= 8})
    model.least = _least({k: [t for t in texts[k] if t] for k in model})
    return model


def _plain():
    return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)


def _compressors(model: dict[str, bytes]):
    out = []
    for content in model.values():
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def _predict(model):
    def run(batches):
        names = list(model.value)
        tools = _compressors(model.value)
        every, least = [*tools, _plain()], getattr(model.value, "least", 0.0)
        for batch in batches:
            lang, score, margin, rejected = [], [], [], []
            for text in batch.column("text").to_pylist():
                if text is None or not tools or not _LETTER.search(text):
                    lang.append("und")
                    score.append(0.0)
                    margin.append(0.0)
                    rejected.append(True)
                    continue
                *size, plain = _sizes(normal(text), every)
                size = np.array(size)
                k = int(size.argmin())
                apart, known = evidence(size, plain)
                lang.append(names[k])
                score.append(float(1 / np.exp2(np.maximum(size[k] - size, -1000) / 4).sum()))
                margin.append(apart)
                rejected.append(known <= least)
            keep = [i for i, c in enumerate(batch.schema.names) if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in keep), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array(rejected, pa.bool_())],
                names=[*(batch.schema.names[i] for i in keep), "lang_pred", "score", "margin", "rejected"],
            )

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin and rejected for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DICT_BYTES a language
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_predict(shared), "doc_id long, held_out boolean, lang_pred string, score double, margin double, rejected boolean")


def _keep(model):
    inner = _predict(model)

    def run(batches):
        for batch in batches:
            text = batch.column("text")
            judged = next(inner(iter([pa.RecordBatch.from_arrays([text], names=["text"])])))
            yield batch.filter(pa.array([not x for x in judged.column("rejected").to_pylist()], pa.bool_()))

    return run


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that are not rejected, with all their columns. All rows if nothing was learned: then no text can
    be told from any other."""
    if not model:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_keep(shared), docs.schema)
