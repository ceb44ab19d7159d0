"""The TF-IDF and logistic regression baseline, with pyspark.ml: training, batched inference, attribution of verdicts to words.

A text's features are word 1- to 3-grams and character 2- to 5-grams inside words, each with sublinear term
frequency (1 + ln tf), inverse document frequency and unit length.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml import classification as ml
from pyspark.ml.common import _py2java
from pyspark.ml.feature import (
    IDF, CountVectorizer, CountVectorizerModel, ElementwiseProduct, IndexToString, NGram, Normalizer, RegexTokenizer, SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler,
)
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.ml.linalg import DenseMatrix, DenseVector, SparseVector, VectorUDT
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import softmax
from .softmax import grams_of, runs_of

#: What both feature sets are called in the pipeline: word grams, character grams.
KINDS = ("_w", "_c")
#: Rows of the regression are kept in blocks of this size.  Each block costs a pass over a matrix as large as the model, so small ones (1 MB by default) make the work grow with rows times terms.
BLOCK_MB = 64.0
GRAMS = "flatten(transform(sequence(2, 5), n -> transform(sequence(1, greatest(length(w) + 3 - n, 1)), i -> substring(concat(' ', w, ' '), i, n))))"


def input_text(sql: str = "sql", schema: str = "schema_text"):
    return F.concat_ws(" ||| ", sql, schema)


@F.udf(VectorUDT())
def _sublinear(size: int, indices: list[int], values: list[float]) -> SparseVector:
    return SparseVector(size, indices, [1.0 + math.log(v) for v in values])


class SublinearTF(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Term counts (sparse vectors) as 1 + ln count; saved and loaded with its pipeline."""

    @keyword_only
    def __init__(self, inputCol: str | None = None, outputCol: str | None = None) -> None:  # noqa: N803
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        v = F.unwrap_udt(F.col(self.getInputCol()))
        return dataset.withColumn(self.getOutputCol(), _sublinear(v["size"], v["indices"], v["values"]))


def pipeline(labels: list[str], c: float = 4.0, rows: int = 1000, vocabulary: int = 200_000, min_df: float = 2.0, sublinear: bool = True) -> Pipeline:
    """Word 1- to 3-grams and character 2- to 5-grams inside words (column ``text``), weighed, normalised, side by side, then multinomial regression (column ``label``)."""
    chars = f"flatten(transform(filter(split(lower(text), '\\\\s+'), w -> w <> ''), w -> {GRAMS}))"
    stages = [StringIndexer(inputCol="label", outputCol="_y", stringOrderType="alphabetAsc", handleInvalid="keep"), RegexTokenizer(inputCol="text", outputCol="_w1", pattern=r"\w+", gaps=False), SQLTransformer(statement=f"SELECT *, {chars} AS _c FROM __THIS__")]
    stages += [NGram(n=n, inputCol="_w1", outputCol=f"_w{n}") for n in (2, 3)]
    stages.append(SQLTransformer(statement="SELECT *, concat(_w1, _w2, _w3) AS _w FROM __THIS__"))
    stages += [CountVectorizer(inputCol=name, outputCol=f"{name}_n", vocabSize=vocabulary, minDF=min_df) for name in KINDS]
    for name in KINDS:
        if sublinear:
            stages.append(SublinearTF(inputCol=f"{name}_n", outputCol=f"{name}_s"))
        stages += [IDF(inputCol=f"{name}_s" if sublinear else f"{name}_n", outputCol=f"{name}_i"), Normalizer(inputCol=f"{name}_i", outputCol=f"{name}_v")]
    stages += [VectorAssembler(inputCols=[f"{k}_v" for k in KINDS], outputCol="_x"), LogisticRegression(featuresCol="_x", labelCol="_y", regParam=1 / (c * rows), elasticNetParam=0.0, standardization=False, maxIter=100, family="multinomial", maxBlockSizeInMB=BLOCK_MB), IndexToString(inputCol="prediction", outputCol="y_pred", labels=labels)]
    return Pipeline(stages=stages)


class LogisticRegression(ml.LogisticRegression):
    """pyspark.ml's regression.  Where its features are blocks of texts (``softmax.Block``) instead of vectors, it takes the same steps over these: a text's cost is that of its own terms then."""

    #: Of blocks: the number of terms.
    terms = 0

    def _fit(self, dataset: DataFrame) -> ml.LogisticRegressionModel:
        if isinstance(dataset.schema[self.getFeaturesCol()].dataType, VectorUDT):
            return super()._fit(dataset)
        classes = len(dataset.schema[self.getLabelCol()].metadata["ml_attr"]["vals"])
        weights, intercept, self.objective = softmax.regression(dataset, self.getFeaturesCol(), classes, self.terms, self.getRegParam(), self.getMaxIter(), self.getTol())
        sc = dataset.sparkSession.sparkContext
        java = sc._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(self.uid, _py2java(sc, DenseMatrix(classes, self.terms, weights.ravel(), True)), _py2java(sc, DenseVector(intercept)), classes, True)
        return self._copyValues(ml.LogisticRegressionModel(java))


def _vocabulary(terms: list[str], stage: CountVectorizer) -> CountVectorizerModel:
    """What ``stage`` would fit.  Terms have no line ends, so all go at once."""
    array = SparkSession.getActiveSession()._jvm.java.util.regex.Pattern.compile("\n").split("\n".join(terms), -1)
    return stage._copyValues(CountVectorizerModel(SparkSession.getActiveSession()._jvm.org.apache.spark.ml.feature.CountVectorizerModel(stage.uid, array)))


def _term_counts(train: DataFrame) -> DataFrame:
    """kind, term, total, texts: how often each gram occurs, and in how many texts."""
    out = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("term", T.StringType()), T.StructField("total", T.LongType()), T.StructField("texts", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in softmax.gathered((x,) for b in batches for x in b.column(0).to_pylist()):
            for kind, total, texts in softmax.term_counts([x for x, in block]):
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(total), pa.int32()), pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64()), pa.array([texts[g] for g in total], pa.int64())], out.names)

    return train.select("text").mapInArrow(run, out).groupBy("kind", "term").agg(F.sum("total").alias("total"), F.sum("texts").alias("texts"))


def _blocks(train: DataFrame, labels: list[str], terms: list[list[str]], idf: list[np.ndarray], sublinear: bool) -> DataFrame:
    """_y, _x: the texts' classes and features, as blocks."""
    held = train.sparkSession.sparkContext.broadcast((terms, idf))
    x = T.StructType([T.StructField(n, T.BinaryType()) for n in softmax.Block.FIELDS])
    classes = {"ml_attr": {"type": "nominal", "name": "_y", "vals": [*labels, "__unknown"]}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, idf = held.value
        places, number = [{t: i for i, t in enumerate(x)} for x in terms], {y: i for i, y in enumerate(labels)}
        for block in softmax.gathered(r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
            found = softmax.Block.of([t for t, _ in block], [number[y] for _, y in block], places, idf, sublinear)
            packed = found.packed()
            yield pa.RecordBatch.from_arrays([pa.array([packed["y"]]), pa.StructArray.from_arrays([pa.array([v]) for v in packed.values()], list(packed))], ["_y", "_x"])

    return train.select("text", "label").mapInArrow(run, T.StructType([T.StructField("_y", T.BinaryType()), T.StructField("_x", x)])).withMetadata("_y", classes)


def fit(train: DataFrame, **parameters) -> PipelineModel:
    """The fitted pipeline.  Terms are counted in one pass over the texts; a second one makes blocks of their features, over which the regression goes.

    The blocks lie in one partition for each core, or fewer if they are small: a partition's gradient, as large as the model, is sent at every step.
    """
    by_label = {r["label"]: r for r in train.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).collect()}
    labels, rows = sorted(by_label), sum(r["n"] for r in by_label.values())
    full = max(rows / softmax.ROWS, sum(r["chars"] or 0 for r in by_label.values()) / softmax.CHARS)
    stages = pipeline(labels, rows=rows, **parameters).getStages()
    models, terms, idf = [], [], []
    counts = _term_counts(train).filter(F.col("texts") >= min(least(s, rows) for s in stages if isinstance(s, CountVectorizer))).persist()
    for s in stages:
        if isinstance(s, StringIndexer):
            models.append(StringIndexerModel.from_labels(labels, s.getInputCol(), s.getOutputCol(), s.getHandleInvalid()))
        elif isinstance(s, CountVectorizer):
            of_kind = counts.filter((F.col("kind") == KINDS.index(s.getInputCol())) & (F.col("texts") >= least(s, rows)))
            top = of_kind.orderBy(F.desc("total"), "term").limit(s.getVocabSize()).select("term", "texts").toArrow()
            terms.append(top["term"].to_pylist())
            idf.append(np.log((rows + 1) / (top["texts"].to_numpy() + 1)))
            models.append(_vocabulary(terms[-1], s))
        elif isinstance(s, IDF):
            models.append(ElementwiseProduct(scalingVec=DenseVector(idf[KINDS.index(s.getOutputCol()[:-2])]), inputCol=s.getInputCol(), outputCol=s.getOutputCol()))
        elif isinstance(s, LogisticRegression):
            counts.unpersist()
            s.terms = sum(map(len, terms))
            blocks = _blocks(train, labels, terms, idf, any(isinstance(x, SublinearTF) for x in stages))
            models.append(s.fit(blocks.coalesce(min(train.sparkSession.sparkContext.defaultParallelism, math.ceil(4 * full)))))
        else:
            models.append(s)
    return PipelineModel(models)


def least(stage: CountVectorizer, rows: int) -> float:
    """In how many texts a term must be."""
    return stage.getMinDF() if stage.getMinDF() >= 1 else stage.getMinDF() * rows


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """The rows with y_pred, confidence and probabilities (map of class to probability)."""
    labels = model.stages[-1].getLabels()
    p = vector_to_array("probability")
    out = model.transform(rows).withColumn("_p", p)
    probabilities = F.map_from_arrays(F.array(*(F.lit(x) for x in labels)), F.slice("_p", 1, len(labels)))
    return out.select(*rows.columns, "y_pred", F.array_max(F.slice("_p", 1, len(labels))).alias("confidence"), probabilities.alias("probabilities"))


def _parts(model: PipelineModel) -> dict:
    """Terms, weights of terms and coefficients of a fitted pipeline; bounded by its vocabularies (400,000 terms by default)."""
    by = lambda kind: [s for s in model.stages if type(s).__name__ == kind]
    lr = by("LogisticRegressionModel")[0]
    return {
        "labels": list(model.stages[-1].getLabels()), "terms": [list(m.vocabulary) for m in by("CountVectorizerModel")], "idf": [m.idf.toArray() for m in by("IDFModel")] or [m.getScalingVec().toArray() for m in by("ElementwiseProduct")],
        "coefficients": lr.coefficientMatrix.toArray(), "intercept": lr.interceptVector.toArray(), "sublinear": bool(by("SublinearTF")),
    }


def features_of(text: str) -> tuple[list[str], list[str]]:
    """Word grams and character grams of a text, repeated ones repeated, as the pipeline makes them."""
    words = re.findall(r"\w+", text.lower(), re.A)
    chars = [g for w in runs_of(text) for g in grams_of(w)]
    return [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)], chars


class Scorer:
    """A model in a worker: what ``_parts`` gives, with the terms' places."""

    def __init__(self, parts: dict):
        # terms of no weight anywhere are no terms of a text
        self.places = [{t: i for i, t in enumerate(terms) if idf[i]} for terms, idf in zip(parts["terms"], parts["idf"], strict=True)]
        self.start, self.labels = [0, len(parts["terms"][0])], parts["labels"]
        self.weights, self.intercept = np.ascontiguousarray(parts["coefficients"]), parts["intercept"]
        self.idf, self.sublinear = parts["idf"], parts["sublinear"]

    def margins(self, texts: list[str | None]) -> tuple[softmax.Block, np.ndarray]:
        """The texts' features; the margins, classes by texts."""
        block = softmax.Block.of(texts, [0] * len(texts), self.places, self.idf, self.sublinear)
        return block, block.margins(self.weights, self.intercept)

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        """Texts by classes."""
        _, margins = self.margins(texts)
        e = np.exp(margins - margins.max(axis=0))
        return (e / e.sum(axis=0)).T

    def words(self, texts: list[str | None]) -> Iterator[tuple[str, dict[str, float]]]:
        """For each text the predicted label, and what each word adds to its margin.

        What a pattern's words add, but for the norm, is worked out once for each class; a text's own terms add to it, and change what the pattern's occurrences of them add.
        """
        block, margins = self.margins(texts)
        scale, best = block.scale.reshape(2, -1).tolist(), margins[: len(self.labels)].argmax(axis=0).tolist()
        patterns, at, own = softmax.shaped(texts)
        known = [[_occurrences(k, x, self.places[k]) for k, x in enumerate((p.counts[0].elements(), p.runs))] for p in patterns]
        tables: dict[tuple[int, int], list[dict[str, float]]] = {}

        def share(k: int, i: int, n: int, y: int) -> float:
            """Of one of a term's n occurrences, but for the norm."""
            return float(self.weights[y, self.start[k] + i] * self.idf[k][i]) * ((1 + math.log(n)) / n if self.sublinear else 1.0)

        for n, (p, y, mine) in enumerate(zip(at, best, own, strict=True)):
            if (p, y) not in tables:
                tables[p, y] = [{}, {}]
                for k, table in enumerate(tables[p, y]):
                    for i, (c, words) in known[p][k].items():
                        for w, m in words.items():
                            table[w] = table.get(w, 0.0) + share(k, i, c, y) * m
            total: dict[str, float] = {}
            for k, table in enumerate(tables[p, y]):
                for w, x in table.items():
                    total[w] = total.get(w, 0.0) + x * scale[k][n]
                for i, (c, words) in _occurrences(k, mine[k], self.places[k]).items():
                    before, others = known[p][k].get(i, (0, {}))
                    new = share(k, i, before + c, y) * scale[k][n]
                    for w, m in words.items():
                        total[w] = total.get(w, 0.0) + new * m
                    for w, m in others.items():
                        total[w] += (new - share(k, i, before, y) * scale[k][n]) * m
            yield self.labels[y], total


def _occurrences(kind: int, found: Iterable[str], places: dict[str, int]) -> dict[int, list]:
    """Of word grams or runs: for each term how often it occurs, and how many of these times go to each word."""
    out: dict[int, list] = {}
    for x in found:
        grams, words = (grams_of(x), (x,)) if kind else ((x,), x.split(" "))
        for g in grams:
            if (i := places.get(g)) is not None:
                here = out.setdefault(i, [0, {}])
                here[0] += 1
                for w in words:
                    here[1][w] = here[1].get(w, 0.0) + 1 / len(words)
    return out


def batch_predictor(model: PipelineModel, text: str = "text", batch_size: int = 256):
    """A column of probabilities (array in the order of the labels) by batched inference: a worker puts the model together once and scores batches of texts.

    The model travels as a broadcast variable, whose size is bounded by its vocabularies.
    """
    held = SparkSession.getActiveSession().sparkContext.broadcast(_parts(model))

    def load():
        scorer = Scorer(held.value)
        return lambda texts: scorer.probabilities(texts.ravel().tolist())

    return predict_batch_udf(load, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size)(F.coalesce(F.col(text), F.lit("")))


def predict_batched(model: PipelineModel, rows: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``predict``, by batched inference."""
    labels = model.stages[-1].getLabels()
    out = rows.withColumn("_p", F.slice(batch_predictor(model, text), 1, len(labels)))
    top = F.array_max("_p")
    names = F.array(*(F.lit(x) for x in labels))
    return out.select(*rows.columns, F.get(names, F.array_position("_p", top).cast("int") - 1).alias("y_pred"), top.alias("confidence"), F.map_from_arrays(names, "_p").alias("probabilities"))


def contributions(model: PipelineModel, rows: DataFrame, key: str = "id") -> DataFrame:
    """key, label (the predicted one), kind, term, count, contribution: what each term adds to the margin of the predicted class.

    The sparse features of a row become rows, which join the vocabulary and the class's coefficients.
    """
    spark, parts = rows.sparkSession, _parts(model)
    sizes = [len(t) for t in parts["terms"]]
    kinds = np.repeat(np.arange(2), sizes)
    names = [t for terms in parts["terms"] for t in terms]
    weights = parts["coefficients"][: len(parts["labels"])]
    # one row for each term, with the coefficients of all classes
    vocabulary = spark.createDataFrame([(i, KINDS[kinds[i]], t, weights[:, i].tolist()) for i, t in enumerate(names)], "_at int, kind string, term string, _weights array<double>")
    out = model.transform(rows)
    v = F.unwrap_udt(F.col("_x"))

    def counted(k: str, shift: int):
        c = F.unwrap_udt(F.col(f"{k}_n"))
        return F.map_entries(F.map_from_arrays(F.transform(c["indices"], lambda i: (i + shift).cast("int")), c["values"]))

    counts = F.concat(*(counted(k, shift) for k, shift in zip(KINDS, (0, sizes[0]), strict=True)))
    n = F.map_from_entries(counts)
    # a dense vector has no list of places
    places = F.coalesce(v["indices"], F.sequence(F.lit(0), F.size(v["values"]) - 1))
    each = out.select(key, F.col("y_pred").alias("label"), F.col("prediction").cast("int").alias("_y"), n.alias("_n"), F.explode(F.arrays_zip(places.alias("at"), v["values"].alias("x"))).alias("_f")).filter(F.col("_f.x") != 0)
    found = each.select(key, "label", "_y", F.col("_f.at").alias("_at"), F.col("_f.x").alias("_v"), F.try_element_at("_n", F.col("_f.at")).alias("count")).join(F.broadcast(vocabulary), "_at")
    return found.select(key, "label", "kind", "term", F.col("count").cast("long").alias("count"), (F.col("_v") * F.get("_weights", F.col("_y"))).alias("contribution"))


def word_contributions(model: PipelineModel, rows: DataFrame, key: str = "id") -> DataFrame:
    """key, label, word, contribution: the terms' contributions, merged to the words that they are pieces of.

    A term's contribution is shared evenly among its occurrences; an occurrence of a word n-gram evenly among its words,
    one of a character n-gram goes to the run of characters that it lies in.  The sum over a row's words is its margin without the intercept.
    A row's words come from that row alone, by batched inference: no term is shuffled.
    """
    held = rows.sparkSession.sparkContext.broadcast(_parts(model))
    out = T.StructType([rows.schema[key], T.StructField("label", T.StringType()), T.StructField("word", T.StringType()), T.StructField("contribution", T.DoubleType())])
    kind = to_arrow_type(rows.schema[key].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for b in batches:
            found = [(i, label, w, c) for block in softmax.gathered(zip(b.column(1).to_pylist(), range(len(b)), strict=True)) for (_, i), (label, words) in zip(block, scorer.words([x for x, _ in block]), strict=True) for w, c in words.items()]
            at, labels, words, shares = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())).cast(kind), pa.array(labels, pa.string()), pa.array(words, pa.string()), pa.array(shares, pa.float64())], out.names)

    return rows.select(key, "text").mapInArrow(run, out)


def save(model: PipelineModel, path: str, metadata: dict) -> None:
    """The model and what is to be known of it (JSON), in a folder that executors share."""
    spark = SparkSession.getActiveSession()
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(metadata, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load(path: str) -> tuple[PipelineModel, dict]:
    return PipelineModel.load(f"{path}/model"), json.loads(SparkSession.getActiveSession().read.text(f"{path}/metadata").first()["value"])
