"""Token classification: labels to roles, runs of tokens to spans, and the plug-in point of a model.

Tokens are rows (doc, pos, label, conf, start, end in bytes). Runs are islands over a window of one document, so the only
shuffle is by document. A model is a folder with model.onnx, tokenizer.json and labels.json, or a ``Model`` of their
contents; without one there are no tokens and detection goes by rules alone.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .resolve import CANDIDATE

#: Labels of the default model, and the files that a model needs.
LABELS = ["O", "B-DATE", "I-DATE", "B-PER", "I-PER", "B-ORG", "I-ORG", "B-LOC", "I-LOC"]
FILES = ["model.onnx", "tokenizer.json", "labels.json"]
MAX_TOKENS = 512
#: A folder's files of up to so many bytes together are broadcast; larger ones must lie in that folder on every executor.
MODEL_BYTES = 512 << 20
#: Tokens, padding included, that the model gets at once, and windows whose texts are held together.
BATCH_TOKENS, HELD_WINDOWS = 16384, 256


@dataclass(frozen=True)
class Model:
    """The contents of a model's files."""

    onnx: bytes
    tokenizer: str
    labels: tuple[str, ...]

    @staticmethod
    def read(folder: str) -> Model:
        """The model in a folder; an error names the files that lack."""
        lacking = [f for f in FILES if not os.path.exists(os.path.join(folder, f))]
        if lacking:
            raise FileNotFoundError(f"no {', '.join(lacking)} in {folder!r} on this machine")
        onnx, tokenizer, labels = (open(os.path.join(folder, f), "rb").read() for f in FILES)
        labels = json.loads(labels)
        return Model(onnx, tokenizer.decode(), tuple(labels if isinstance(labels, list) else (labels[str(i)] for i in range(len(labels)))))


def category_of(label: str) -> str:
    """SQL: the category of a label's type, null for other types."""
    kind = f"upper(regexp_replace({label}, '^[BbIi]-', ''))"
    return f"CASE WHEN startswith({kind}, 'PER') THEN 'person' WHEN {kind} IN ('ORG', 'ORGANIZATION') THEN 'firma' WHEN {kind} IN ('LOC', 'GPE', 'FAC', 'LOCATION') THEN 'ort' WHEN {kind} IN ('MISC', 'PRODUCT', 'WORK_OF_ART', 'EVENT') THEN 'sonstiges' WHEN {kind} IN ('DATE', 'TIME') THEN 'datum' END"


def roles(tokens: DataFrame) -> DataFrame:
    """``tokens`` with role (begin, inside, outside) and category."""
    inside = "CASE WHEN label IS NULL OR upper(label) = 'O' THEN 'outside' WHEN label rlike '^[Bb]-' THEN 'begin' WHEN label rlike '^[Ii]-' THEN 'inside' ELSE 'outside' END"
    out = tokens.withColumn("category", F.expr(category_of("label"))).withColumn("role", F.expr(inside))
    return out.withColumn("role", F.when(F.col("category").isNull(), "outside").otherwise(F.col("role")))


def softmax_argmax(logits: str) -> str:
    """SQL: struct (label index, probability) of an array of logits; the first of equal maxima."""
    top = f"array_max({logits})"
    return f"named_struct('label', cast(array_position({logits}, {top}) - 1 AS int), 'conf', 1D / aggregate({logits}, 0D, (__s, __v) -> __s + exp(cast(__v - {top} AS double))))"


def merge_tokens(tokens: DataFrame, texts: DataFrame | None = None, doc: str = "doc_id") -> DataFrame:
    """(doc, category, start, end, conf, n_tokens) of each run: one begins where a token says so or the category changes, and
    ends before one outside. With ``texts`` (doc, text): also the text, blank ones left out."""
    by_doc = Window.partitionBy(doc).orderBy("pos")
    marked = roles(tokens).withColumn("before", F.lag(F.when(F.col("role") != "outside", F.col("category"))).over(by_doc))
    marked = marked.filter("role <> 'outside'").withColumn("new", F.expr("role = 'begin' OR before IS NULL OR before <> category").cast("int"))
    numbered = marked.withColumn("run", F.sum("new").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    out = numbered.groupBy(doc, "run").agg(F.first("category").alias("category"), F.min("start").alias("start"), F.max("end").alias("end"), F.least(F.greatest(F.avg("conf"), F.lit(0.0)), F.lit(1.0)).alias("conf"), F.count("*").alias("n_tokens")).drop("run")
    if texts is None:
        return out
    piece = F.expr("decode(substring(encode(text, 'UTF-8'), start + 1, end - start), 'UTF-8')")
    return out.join(texts.select(doc, "text"), doc).withColumn("text", piece).filter("trim(text) <> ''")


def as_candidates(spans: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, ner): spans with text as candidates for ``resolve.detect(ner_col='ner')``."""
    made = spans.groupBy(doc, "category", "text").agg(F.max("conf").alias("conf"), F.sort_array(F.collect_list(F.struct(F.col("start").cast("int").alias("s"), F.col("end").cast("int").alias("e")))).alias("offs"))
    one = F.expr(f"cast(named_struct('p', 9, 'cat', category, 't', text, 'conf', conf, 'src', 'ner', 'occ', size(offs), 'offs', offs, 'review', false, 'feats', map('ner', 'onnx', 'model', 'local_token_classification', 'ner_cat', category)) AS {CANDIDATE})")
    return made.withColumn("c", one).groupBy(doc).agg(F.collect_list(F.struct(F.expr("offs[0].s").alias("s"), "text", "c")).alias("x")).withColumn("x", F.expr("array_sort(x, (l, r) -> CASE WHEN l.s <> r.s THEN l.s - r.s WHEN l.text < r.text THEN -1 WHEN l.text > r.text THEN 1 ELSE 0 END)")).select(doc, F.transform("x", lambda y: y["c"]).alias("ner"))


def model_dir(spark: SparkSession, path: str | None = None) -> str | None:
    """The model's folder: the argument, else spark.veilspark.ner.model, else VEILSPARK_NER_MODEL; null if files lack."""
    path = path or spark.conf.get("spark.veilspark.ner.model", "") or os.environ.get("VEILSPARK_NER_MODEL")
    return path if path and all(os.path.exists(os.path.join(path, f)) for f in FILES) else None


def ner_status(spark: SparkSession, path: str | None = None) -> DataFrame:
    """One row that tells whether a model can be used."""
    found = model_dir(spark, path)
    return spark.createDataFrame([(found is not None, found, ",".join(FILES), ",".join(LABELS), MAX_TOKENS)], "available boolean, model_dir string, needs string, labels string, max_tokens int")


def byte_places(text: str) -> np.ndarray:
    """The byte at which each character begins, and the text's length in bytes."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    return np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))])


def best_of(places: np.ndarray, labels: np.ndarray, conf: np.ndarray) -> np.ndarray:
    """Of rows of equal place the index of the surest, the first of equals; by place."""
    order = np.lexsort((np.arange(len(places)), -conf, places))
    return order[np.concatenate([[True], np.diff(places[order]) > 0])] if len(order) else order


def batches(lengths: Sequence[int], most: int = BATCH_TOKENS) -> Iterator[np.ndarray]:
    """Indices of windows by length, cut so that a batch padded to its longest has up to ``most`` tokens (or one window)."""
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and lengths[order[end]] * (end + 1 - at) <= most:
            end += 1
        yield order[at:end]
        at = end


class _Session:
    """A model in a task, run on batches of windows."""

    def __init__(self, model: Model, overlap: int | None):
        import onnxruntime
        from tokenizers import Tokenizer

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1  # a task has one core
        self.session = onnxruntime.InferenceSession(model.onnx, options, providers=["CPUExecutionProvider"])
        self.wanted = {i.name for i in self.session.get_inputs()}
        self.tokenizer = Tokenizer.from_str(model.tokenizer)
        self.pad = (self.tokenizer.padding or {}).get("pad_id", 0)
        self.tokenizer.no_padding()
        self.tokenizer.enable_truncation(MAX_TOKENS, stride=overlap or 0)
        self.step = MAX_TOKENS - self.tokenizer.num_special_tokens_to_add(False) - (overlap or 0)
        self.whole = overlap is not None

    def windows(self, text: str) -> list:
        first = self.tokenizer.encode(text)
        return [first, *first.overflowing] if self.whole else [first]

    def classified(self, windows: list) -> list[tuple[np.ndarray, np.ndarray]]:
        """(label numbers, their probabilities) of the tokens of each window."""
        out: list = [None] * len(windows)
        for some in batches([len(w.ids) for w in windows]):
            width = len(windows[some[-1]].ids)
            padded = lambda rows, fill: np.array([[*r, *[fill] * (width - len(r))] for r in rows], dtype=np.int64)
            feed = {"input_ids": ("ids", self.pad), "attention_mask": ("attention_mask", 0), "token_type_ids": ("type_ids", 0)}
            logits = self.session.run(None, {k: padded([getattr(windows[i], field) for i in some], fill) for k, (field, fill) in feed.items() if k in self.wanted})[0].astype(np.float32)
            shifted = np.exp(logits - logits.max(axis=2, keepdims=True))
            best, probability = shifted.argmax(axis=2), shifted.max(axis=2) / shifted.sum(axis=2)
            for at, i in enumerate(some):
                out[i] = best[at, : len(windows[i].ids)], probability[at, : len(windows[i].ids)]
        return out

    def rows(self, keys: list, texts: list[str], windows: list[list], labels: Sequence[str], doc: str, outside: bool = True) -> pd.DataFrame:
        found = iter(self.classified([w for of_text in windows for w in of_text]))
        plain = np.array([x.upper() == "O" for x in labels])
        parts = []
        for row, (text, of_text) in enumerate(zip(texts, windows, strict=True)):
            place, label, conf, at = [], [], [], []
            lead = None
            for number, window in enumerate(of_text):
                best, probability = next(found)
                inside = np.flatnonzero(np.array(window.special_tokens_mask) == 0)
                if not len(inside):
                    continue
                # Overlapping windows are told apart by the token's number in the text.
                lead = int(inside[0]) if lead is None else lead
                place.append(np.arange(len(inside)) + number * self.step + lead)
                label.append(best[inside])
                conf.append(probability[inside])
                at.append(np.stack([np.full(len(inside), number), inside]))
            if not place:
                continue
            place, label, conf = map(np.concatenate, (place, label, conf))
            kept = best_of(place, label, conf)
            if not outside:
                none = plain[label[kept]]
                kept = kept[~none | ~np.concatenate([[True], none[:-1]])]
            if not len(kept):
                continue
            of_kept = np.concatenate(at, axis=1)[:, kept]
            if len(kept) * 4 < len(place):
                spans = np.array([of_text[w].token_to_chars(i) or (0, 0) for w, i in of_kept.T.tolist()])
            else:
                spans = np.concatenate([np.array(w.offsets) for w in of_text if len(w.ids)])[np.concatenate([[0], np.cumsum([len(w.ids) for w in of_text])])[of_kept[0]] + of_kept[1]]
            byte = byte_places(text)
            parts.append((np.full(len(kept), row), place[kept].astype(np.int32), label[kept], conf[kept].astype(np.float64), byte[spans[:, 0]].astype(np.int32), byte[spans[:, 1]].astype(np.int32)))
        if not parts:
            return pd.DataFrame(columns=[doc, "pos", "label", "conf", "start", "end"])
        row, place, label, conf, start, end = map(np.concatenate, zip(*parts, strict=True))
        named = np.empty(len(keys), dtype=object)
        named[:] = keys
        return pd.DataFrame({doc: named[row], "pos": place, "label": np.array(labels, dtype=object)[label], "conf": conf, "start": start, "end": end})


def tokens_of(docs: DataFrame, path: str | None = None, doc: str = "doc_id", text_col: str = "text", model: Model | None = None, overlap: int | None = None, outside: bool = True) -> DataFrame:
    """(doc, pos, label, conf, start, end) of the tokens of each text; no rows without a model, and none of null or empty texts.

    Of a text the first MAX_TOKENS tokens are read. With ``overlap`` all are, in windows of MAX_TOKENS that share so many;
    of a token's labels the surest stays, the first of equals. Windows of several texts, sorted by length, go to the model
    together. Ids should be unique, since runs are told apart by them. Without ``outside``, tokens labelled O are left out but
    for the first behind others: ``merge_tokens`` gives the same runs.
    """
    spark = docs.sparkSession
    if overlap is not None and not 0 <= overlap < MAX_TOKENS // 2:
        raise ValueError(f"overlap must be below {MAX_TOKENS // 2}")
    folder = None if model else model_dir(spark, path)
    schema = f"`{doc}` {docs.schema[doc].dataType.simpleString()}, pos int, label string, conf double, start int, end int"
    if model is None and folder is None:
        return spark.createDataFrame([], schema)
    if model is None and sum(os.path.getsize(os.path.join(folder, f)) for f in FILES) <= MODEL_BYTES:
        model = Model.read(folder)
    shared = spark.sparkContext.broadcast(model) if model else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used = shared.value if shared else Model.read(folder)
        session = _Session(used, overlap)
        for frame in frames:
            held: tuple[list, list, list] = ([], [], [])
            count = 0
            for key, text in zip(frame.iloc[:, 0], frame.iloc[:, 1], strict=True):
                if not text:
                    continue
                windows = session.windows(text)
                for values, value in zip(held, (key, text, windows), strict=True):
                    values.append(value)
                count += len(windows)
                if count >= HELD_WINDOWS:
                    yield session.rows(*held, used.labels, doc, outside)
                    held, count = ([], [], []), 0
            yield session.rows(*held, used.labels, doc, outside)

    return docs.select(doc, F.col(text_col).cast("string").alias("__text")).mapInPandas(run, schema)


def _field(number: int, value: int | bytes | str) -> bytes:
    """A field of a protocol buffer: a number or a string of bytes."""

    def varint(n: int) -> bytes:
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    data = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(data)) + data


def word_model(words: dict[str, Sequence[str]], logit: float = 8.0) -> Model:
    """A model that labels by the word only (a table of logits that ids look up), for lists of words by label and to try the
    model path: a word of several lists has the first one's label, all others O. Words are what stands between spaces, tabs
    and line ends."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    labels = ["O", *(x for x in words if x != "O")]
    of_word: dict[str, str] = {}
    for label, some in words.items():
        for word in some:
            of_word.setdefault(word, label)
    vocabulary = {"[UNK]": 0} | {w: i for i, w in enumerate(of_word, 1)}
    tokenizer = Tokenizer(models.WordLevel(vocabulary, unk_token="[UNK]"))
    tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex("[ \\t\\n\\r]+"), "removed")
    table = np.zeros((len(vocabulary), len(labels)), dtype="<f4")
    table[np.arange(len(vocabulary)), [0, *(labels.index(label) for label in of_word.values())]] = logit
    # Field numbers of the ONNX format (model 7 and 8; graph 1, 2, 5, 11, 12; node 1, 2, 4; tensor 1, 2, 8, 9).
    tensor = b"".join(_field(1, d) for d in table.shape) + _field(2, 1) + _field(8, "table") + _field(9, table.tobytes())
    value = lambda name, kind, dims: _field(1, name) + _field(2, _field(1, _field(1, kind) + _field(2, b"".join(_field(1, _field(2, d) if isinstance(d, str) else _field(1, d)) for d in dims))))
    node = _field(1, "table") + _field(1, "input_ids") + _field(2, "logits") + _field(4, "Gather")
    graph = _field(1, node) + _field(2, "words") + _field(5, tensor) + _field(11, value("input_ids", 7, ["batch", "tokens"])) + _field(12, value("logits", 1, ["batch", "tokens", len(labels)]))
    return Model(_field(1, 8) + _field(7, graph) + _field(8, _field(2, 13)), tokenizer.to_str(), tuple(labels))
