"""Operator 9: language spans by script ranges and Viterbi over per-word scores.

The script of a word narrows its candidates to the trained languages that use the script, as learned from labelled texts;
where none does, to those that the script is commonly used for. A word is scored by the log-probabilities of its byte
trigrams in each candidate. Viterbi with a penalty for switching then labels the words of the whole text; a further state,
``und``, scores every byte of a word in Latin script alike, so that what resembles no language goes there. In scripts
without spaces each character is a word.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import numbered, pick, place
from .textscan import blocks, fold, per_row, words

#: Different labelled texts learned from, at most, in each language; they are those with the lowest hashes of the whole text.
SAMPLE = 400
#: Slots of hashed trigrams; log-odds against a change of language between two words; log-probability of a
#: byte in the state ``und``, and of a byte that was never seen after the two before it.
SLOTS, SWITCH, UNKNOWN, UNSEEN = 1 << 17, 8.0, -4.2, -7.0
#: A text is rejected if more than this share of the bytes of its words is undetermined.
REJECT = 0.5
UND = "und"
#: A trained language uses a script if it has at least this share of the bytes of the language's words.
USES = 0.05
#: Scripts by first code point.
SCRIPTS = [(0x0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x700, "latin"), (0x750, "arabic"), (0x780, "latin"), (0x8A0, "arabic"), (0x900, "devanagari"), (0x980, "bengali"), (0xA00, "gurmukhi"), (0xA80, "gujarati"), (0xB00, "latin"), (0xB80, "tamil"), (0xC00, "telugu"), (0xC80, "kannada"), (0xD00, "malayalam"), (0xD80, "sinhala"), (0xE00, "thai"), (0xE80, "lao"), (0xF00, "tibetan"), (0x1000, "burmese"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "latin"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "latin"), (0x1F00, "greek"), (0x2000, "latin"), (0x2E80, "han"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0x31F0, "kana"), (0x3200, "han"), (0xA000, "latin"), (0xAC00, "hangul"), (0xD7B0, "latin"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "latin"), (0xFE70, "arabic"), (0xFEFF, "latin"), (0xFF66, "kana"), (0xFFA0, "latin"), (0x20000, "han"), (0x32000, "latin")]
#: Candidates for words of a script that no trained language uses, the likelier first.
COMMON = {"greek": ["el"], "cyrillic": ["ru"], "armenian": ["hy"], "hebrew": ["he"], "arabic": ["ar"], "devanagari": ["hi"], "bengali": ["bn"], "gurmukhi": ["pa"], "gujarati": ["gu"], "tamil": ["ta"], "telugu": ["te"], "kannada": ["kn"], "malayalam": ["ml"], "sinhala": ["si"], "thai": ["th"], "lao": ["lo"], "tibetan": ["bo"], "burmese": ["my"], "georgian": ["ka"], "hangul": ["ko"], "ethiopic": ["am"], "khmer": ["km"], "mongolian": ["mn"], "han": ["zh", "ja"], "kana": ["ja"]}
NAMES = sorted({x for _, x in SCRIPTS})
_STARTS, _NAMED = np.array([x for x, _ in SCRIPTS]), np.array([NAMES.index(x) for _, x in SCRIPTS])
LATIN = NAMES.index("latin")
#: What a word scores more in a language common for its script than by its bytes, less for each likelier one; what a language is charged that isn't a candidate.
COMMONLY, LESS, BARRED = 20.0, 0.5, 1e4


def grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the trigrams that end at each byte of the words and after them, and the first one of each word.

    A word is scored as if a mark stood before and after it.
    """
    length = ends - starts + 1
    first = np.concatenate(([0], np.cumsum(length)))
    joined = np.full(first[-1], 32, np.uint8)
    if not len(starts):
        return joined.astype(np.uint32), first
    letters = np.ones(first[-1], bool)
    letters[first[1:] - 1] = False
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    joined[letters] = data[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]
    wide = joined.astype(np.uint32)
    code = wide.copy()
    code[1:] |= wide[:-1] << np.uint32(8)
    code[2:] |= wide[:-2] << np.uint32(16)
    code[first[:-1]] = wide[first[:-1]] | np.uint32(1 << 16 | 32 << 8)
    code[first[:-1] + 1] |= np.uint32(32 << 16)  # the first word of a block has none before it
    return code, first


def slots_of(code: np.ndarray) -> np.ndarray:
    return (code * np.uint32(2654435761)) >> np.uint32(15)


def scripts_of(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Index into NAMES for each word, by its first character."""
    lead = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.int64)
    b = [lead[starts + i] for i in range(4)]
    point = np.where(
        b[0] < 0xC0,
        b[0],
        np.where(b[0] < 0xE0, (b[0] & 31) << 6 | b[1] & 63, np.where(b[0] < 0xF0, (b[0] & 15) << 12 | (b[1] & 63) << 6 | b[2] & 63, (b[0] & 7) << 18 | (b[1] & 63) << 12 | (b[2] & 63) << 6 | b[3] & 63)),
    )
    return _NAMED[np.searchsorted(_STARTS, point, "right") - 1]


def numbers(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which words begin with a digit; they belong to any language."""
    return (data[starts] >= 48) & (data[starts] <= 57)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, text) to counts (lang, code, n) of trigrams, and of bytes in each script under the code -1 - script, summed within a block."""
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for a, b, offsets, data in blocks(batch.column(1)):
            data = fold(data)
            starts, ends, first = words(data, offsets, apart=True)
            codes, begin = grams(data, starts, ends)
            script, size = scripts_of(data, starts), np.where(numbers(data, starts), 0, ends - starts)
            for lang in sorted(set(langs[a:b])):
                rows = langs[a:b] == lang
                code, n = np.unique(codes[np.repeat(rows, np.diff(begin[first]))], return_counts=True)
                word = np.repeat(rows, np.diff(first))
                held = np.bincount(script[word], size[word], len(NAMES)).astype(np.int64)
                used = np.flatnonzero(held)
                code, n = np.concatenate((code.astype(np.int64), -1 - used)), np.concatenate((n, held[used]))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code), pa.array(n.astype(np.int64))], ["lang", "code", "n"])


class Model:
    """Trained languages, sorted, their trigram log-probabilities (slot by language), and which script each one uses (script by language)."""

    def __init__(self, langs: list[str], scores: np.ndarray, uses: np.ndarray) -> None:
        self.langs, self.scores, self.uses = langs, scores, uses


def fit(docs: DataFrame, sample: int = SAMPLE, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> Model:
    """Learns from at most ``sample`` different labelled texts of each language, each once, whole: those with the lowest hashes.

    Rows with null text or label don't count. Each task keeps ``sample`` hashes of a language at most. Without any
    labelled row there are no trained languages: words in Latin script are then undetermined.
    """
    rows = pick(docs, doc_id=id_column, text=text_column, lang=lang_column).where("text is not null and lang is not null and lang <> ''")
    rows = rows.select("lang", "text", F.xxhash64("text").alias("h"))
    lowest = rows.select("lang", "h", F.dense_rank().over(Window.partitionBy("lang").orderBy("h")).alias("nth")).where(F.col("nth") <= sample)
    most = {r["lang"]: r["h"] for r in lowest.groupBy("lang").agg(F.max("h").alias("h")).collect()}
    if not most:
        return Model([], np.zeros((SLOTS, 0), np.float32), np.zeros((len(NAMES), 0), bool))
    limit = F.lit(None).cast("long")
    for lang, h in most.items():
        limit = F.when(F.col("lang") == lang, F.lit(h)).otherwise(limit)
    drawn = rows.where(F.col("h") <= limit).groupBy("lang", "h").agg(F.first("text").alias("text"))
    table = drawn.select("lang", "text").mapInArrow(counted, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(most)
    scores = np.full((SLOTS, len(langs)), UNSEEN, np.float32)
    uses = np.zeros((len(NAMES), len(langs)), bool)
    for i, lang in enumerate(langs):
        own = table[(table["lang"] == lang) & (table["code"] >= 0)].sort_values(["n", "code"])  # where slots clash the more frequent trigram counts
        context = own.groupby(own["code"] // 256)["n"].transform("sum")
        scores[slots_of(own["code"].to_numpy().astype(np.uint32)), i] = np.log((own["n"] + 0.05) / (context + 3.2))
        bytes_in = table[(table["lang"] == lang) & (table["code"] < 0)]
        uses[-1 - bytes_in["code"].to_numpy(), i] = bytes_in["n"].to_numpy() >= USES * bytes_in["n"].sum()
    return Model(langs, scores, uses)


class Lanes:
    """Stretches of up to ``size`` words of each row, longest first, to be walked side by side."""

    def __init__(self, first: np.ndarray, size: int) -> None:
        self.of_row = -(-np.diff(first) // size)
        self.begin = np.concatenate(([0], np.cumsum(self.of_row)))
        row = np.repeat(np.arange(len(first) - 1), self.of_row)
        start = first[row] + size * (np.arange(self.begin[-1]) - self.begin[row])
        length = np.minimum(size, first[row + 1] - start)
        self.order = np.argsort(-length, kind="stable")
        self.start, sorted_length = start[self.order], length[self.order]
        self.active = np.searchsorted(-sorted_length, -np.arange(1, int(length.max(initial=0)) + 1), "right")


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float, size: int = 128) -> np.ndarray:
    """The best state of each word, where each change of state between neighbouring words costs the penalty.

    Exact: stretches are first summed up as (max, +) matrices from each state to each, which are chained within the
    row, and then walked again from what is known at their start. Of equal paths the choice depends on nothing but
    the row.
    """
    n, k = scores.shape
    scores = np.ascontiguousarray(scores.T)
    lanes = Lanes(first, size)
    count = len(lanes.order)
    ways = np.full((k, k, count), -penalty)  # to, from, lane
    ways[np.arange(k), np.arange(k)] = 0.0
    for t, rows in enumerate(lanes.active):
        v = ways[:, :, :rows]
        if t:
            np.maximum(v, v.max(axis=0) - penalty, out=v)
        v += scores[:, lanes.start[:rows] + t][:, None]
    by_lane = np.empty_like(ways)
    by_lane[:, :, lanes.order] = ways
    # chain the lanes of each row, rows with the most lanes first
    rows_order = np.argsort(-lanes.of_row, kind="stable")
    begin = lanes.begin[:-1][rows_order]
    alive = np.searchsorted(-lanes.of_row[rows_order], -np.arange(1, int(lanes.of_row.max(initial=0)) + 1), "right")
    entry = np.zeros((k, count))
    value = np.zeros((k, len(rows_order)))
    for j, rows in enumerate(alive):
        at = begin[:rows] + j
        entry[:, at] = value[:, :rows]
        v = (value[:, :rows] + by_lane[:, :, at]).max(axis=1)
        value[:, :rows] = v - v.max(axis=0)
    state = value.argmax(axis=0)
    last = np.empty(count, np.int64)
    for j in range(len(alive) - 1, -1, -1):
        rows = alive[j]
        at, end = begin[:rows] + j, state[:rows]
        last[at] = end
        state[:rows] = (entry[:, at] + by_lane[end, :, at].T).argmax(axis=0)
    # walk the lanes again, now with what went before
    stay = np.empty((k, n), bool)
    best = np.empty(n, np.int8)
    value = entry[:, lanes.order]
    for t, rows in enumerate(lanes.active):
        at, v = lanes.start[:rows] + t, value[:, :rows]
        top = v.max(axis=0)
        choice = np.zeros(rows, np.int8)
        for i in range(k - 1, -1, -1):
            choice[v[i] == top] = i
        stay[:, at] = v >= top - penalty
        best[at] = choice
        np.maximum(v, top - penalty, out=v)
        v += scores[:, at]
    out = np.empty(n, np.int8)
    now = last[lanes.order]
    for t in range(len(lanes.active) - 1, -1, -1):
        rows = lanes.active[t]
        at, end = lanes.start[:rows] + t, now[:rows]
        out[at] = end
        now[:rows] = np.where(stay[end, at], end, best[at])
    return out


def labelled(model: Model, data: np.ndarray, offsets: np.ndarray, penalty: float):
    """(names, state of each word, starts, ends, first word of each row) of a block. Names are sorted, with UND at the end."""
    folded = fold(data)
    starts, ends, first = words(folded, offsets, apart=True)
    script = scripts_of(folded, starts)
    count = len(model.langs)
    trained = model.uses.any(axis=1)
    common = {k: COMMON.get(NAMES[k], []) for k in np.unique(script).tolist() if not trained[k]}
    names = [*sorted({*model.langs, *(x for few in common.values() for x in few)} - {UND}), UND]
    at = [names.index(x) for x in model.langs]
    scores = np.full((len(starts), len(names)), -BARRED, np.float32)
    if len(starts):
        size = (ends - starts).astype(np.float32)
        alike = UNKNOWN * (size + 1)
        if count:
            codes, begin = grams(folded, starts, ends)
            own = np.add.reduceat(np.take(model.scores, slots_of(codes).astype(np.int64), axis=0, mode="clip"), begin[:-1], axis=0)
            scores[:, at] = np.where(model.uses[script], own, -BARRED)
        open_ = (script == LATIN) | ~trained[script]
        scores[open_, -1] = alike[open_]
        for k, few in common.items():
            here = script == k
            for i, x in enumerate(few):
                scores[here, names.index(x)] = alike[here] + COMMONLY - LESS * i
        scores[numbers(folded, starts)] = 0
    return names, viterbi(scores, first, penalty), starts, ends, first


def spans_of(model: Model, penalty: float, reject: float):
    """Rows (doc_id, text) to (doc_id, lang, share, keep, spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, offsets, data in blocks(batch.column(1), 4 << 20):
                names, state, starts, ends, first = labelled(model, data, offsets, penalty)
                lang, share, keep = verdicts(names, state, starts, ends, first, reject)
                chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                row = np.repeat(np.arange(b - a), np.diff(first))
                new = np.ones(len(state), bool)
                new[1:] = (state[1:] != state[:-1]) | (row[1:] != row[:-1])
                cut = np.flatnonzero(new)
                last = np.concatenate((cut[1:], [len(state)])) - 1 if len(cut) else cut
                base = chars[offsets[row[cut]]]
                structs = pa.StructArray.from_arrays(
                    [pa.array((chars[starts[cut]] - base).astype(np.int32)), pa.array((chars[ends[last]] - base).astype(np.int32)), pa.DictionaryArray.from_arrays(pa.array(state[cut].astype(np.int32)), pa.array(names)).cast(pa.string())],
                    ["start", "end", "lang"],
                )
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(cut, first).astype(np.int32)), structs)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(lang, pa.string()), pa.array(share), pa.array(keep), lists], ["doc_id", "lang", "share", "keep", "spans"])

    return run


def verdicts(names: list[str], state: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, reject: float):
    """Language with the most bytes of each row (ties: the first by name, ``und`` last), its share, and whether the row stays."""
    k = len(names)
    held = np.zeros((len(state), k))
    held[np.arange(len(state)), state] = ends - starts
    total = per_row(held, first, np.add, 0.0)
    whole = total.sum(axis=1)
    top = total.argmax(axis=1)
    share = np.where(whole > 0, total[np.arange(len(total)), top] / np.maximum(whole, 1), 0.0)
    lang = np.where(whole > 0, np.array(names, object)[top], UND)
    return lang.tolist(), share, (whole > 0) & (total[:, -1] <= reject * whole)


def filtered(model: Model, penalty: float, reject: float, at_text: int):
    """Batches less the rows that are rejected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for _, _, offsets, data in blocks(batch.column(at_text), 4 << 20):
                names, state, starts, ends, first = labelled(model, data, offsets, penalty)
                keep.append(verdicts(names, state, starts, ends, first, reject)[2])
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return run


def language_spans(docs: DataFrame, model: Model | None = None, penalty: float = SWITCH, reject: float = REJECT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, lang, share, keep, spans): the main language of each row, its share of the bytes of words, whether
    the row stays, and (start, end, lang) of each run of words in one language, in characters, end exclusive.

    Null, empty and wordless texts are ``und`` with share 0, no spans and keep false; texts of any length are labelled whole. Of languages
    with equal shares the first by name is the main one, ``und`` the last; of equally good labellings that counts whose last word has the first
    language by name and that, going back, stays in a language where it can. Repeated rows give repeated results; null doc_ids stay null. Numbers take
    the language around them. Without a model one is fitted on the rows' own ``lang`` column. Other columns may have any names. An empty table gives no rows.
    """
    model = model or fit(docs, id_column=id_column, text_column=text_column)
    rows = pick(docs, doc_id=id_column, text=text_column).select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(spans_of(model, penalty, reject), "doc_id long, lang string, share double, keep boolean, spans array<struct<start:int,end:int,lang:string>>")


def keep_languages(docs: DataFrame, model: Model | None = None, penalty: float = SWITCH, reject: float = REJECT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows that ``language_spans`` keeps, with all their columns, whatever these are called.

    Rows with a null, empty or wordless text go; a row stays if at most ``reject`` of the bytes of its words, however long it is, is undetermined
    (exactly that much stays). Repeated rows stay or go together. Other columns may be null. An empty table stays empty.
    """
    model = model or fit(docs, id_column=id_column, text_column=text_column)
    inner = numbered(docs)
    return inner.mapInArrow(filtered(model, penalty, reject, place(docs.columns, text_column)), inner.schema).toDF(*docs.columns)
