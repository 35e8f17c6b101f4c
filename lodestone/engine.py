"""The engine: one driver's items, stored and searched. Each call is a plan over its tables."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import options as O
from .errors import InvalidArguments, NoData, NotSupported, SystemFailure
from .features import FeatureKind, Metric, Models, Words, kind_of
from .functions.ids import content_id_of, parse_id
from .operators import inverted, topk
from .operators.strip import OVERFETCH, strip
from .session import delete, exists, importable, shared_dir
from .sources import images as I
from .sources.catalog import Master, table_name
from .streaming.pull import LocalIndex

log = logging.getLogger("lodestone")

#: Keys that an input may have, the first one found decides.
INPUT_KEYS = ("file", "data", "image", "string", "raw", "id")


class Engine:
    """Opened by ``Engine.open``. Inputs are mappings with one of INPUT_KEYS and options of the query."""

    def __init__(self, spark: SparkSession, config: dict, models: Models | None = None):
        importable(spark)
        self.spark, self.config, self.models = spark, config, models or Models()
        name = O.get(config, "driver.name")
        if not name:
            raise InvalidArguments("driver.name is missing")
        self.name = str(name)
        self.kind, self.storage = kind_of(self.name)
        self.kind: FeatureKind
        self.options = {
            "color_weight": O.to_float(O.get(config, "driver.color_weight", self.kind.color_weight)),
            "color_method": O.get(config, "driver.color_method", "linear"),
            "color_threshold": O.to_float(O.get(config, "driver.color_threshold", 0.7)),
            "strip": O.to_bool(O.get(config, "driver.strip", False)),
            "hit_threshold": max(1, O.to_int(O.get(config, "driver.hit_threshold", inverted.HIT_THRESHOLD))),
        }
        rerank = O.get(config, "driver.rerank_method", "idf")
        if rerank not in ("idf", "none"):
            log.warning("unknown rerank_method %r; idf is used", rerank)
            rerank = "idf"
        self.rerank = rerank == "idf"
        self.sync_first = O.to_bool(O.get(config, "driver.sync_before_search", False))
        self.load_fv = O.to_bool(O.get(config, "driver.load_fv", True)) and self.storage != "none"
        table = table_name(str(O.get(config, "namespace", "")), self.name)
        root = str(O.get(config, "driver.data_dir", f"{shared_dir(spark)}/engine")).rstrip("/")
        self.master = Master(spark, f"{O.get(config, 'database.name', root)}/master/{table}")
        self.index = LocalIndex(spark, f"{root}/index/{table}", O.get(config, "driver.shard"))
        self.postings = inverted.StoredIndex(spark, f"{self.index.root}-postings")
        self._active = True

    @classmethod
    def open(cls, spark: SparkSession, config, models: Models | None = None) -> Engine:
        return cls(spark, O.load(config), models)

    @property
    def active(self) -> bool:
        return self._active

    def close(self) -> None:
        self._active = False

    def _stored(self) -> None:
        if self.storage == "none":
            raise NotSupported(f"{self.name} stores nothing")

    # catalogue

    def create_database(self) -> None:
        self._stored()
        self.master.create()

    def drop_database(self) -> None:
        self._stored()
        self.master.drop()
        self.drop_index()

    def drop_index(self) -> None:
        self._stored()
        self.index.drop()
        delete(self.spark, self.postings.root)

    def vacuum_index(self) -> None:
        """Rewrites the index, postings too, in few files; a failure on the way leaves it as it was."""
        self._stored()
        self.index.vacuum()
        if self.storage == "index":
            self.postings.compact()

    def pull(self) -> None:
        self._stored()
        self.index.pull(self.master)
        self._index_postings()

    def _words(self, rows: DataFrame) -> DataFrame:
        return rows.select(F.col("item_id").alias("item"), F.explode(self.kind.decode(F.col("vector"))["words"]).alias("word"))

    def _index_postings(self) -> None:
        """The postings of what was pulled since they were written last; what a failed write left out comes again."""
        if self.storage == "index":
            new = self.index.items().where(F.col("seq") > self.postings.cursor())
            top = new.agg(F.max("seq")).first()[0]
            if top is not None:
                self.postings.add(self._words(new), upto=top)

    def pull_stream(self, checkpoint: str, once: bool = True):
        self._stored()
        also = (lambda rows, name: self.postings.add(self._words(rows), name)) if self.storage == "index" else None
        return self.index.pull_stream(self.master, checkpoint, once, also)

    def count(self) -> int:
        """Items of the index, deleted ones included."""
        self._stored()
        return self.index.items().count()

    def live_count(self) -> int:
        self._stored()
        return topk.live(self.index.items()).count()

    def exists(self, ids: DataFrame) -> DataFrame:
        self._stored()
        return self.master.exists(ids)

    # inputs

    def features(self, inputs: DataFrame) -> DataFrame:
        """(item_id, feature) of images (item_id, image); those whose id is stored are read, the rest extracted."""
        if not self.load_fv:
            return self.kind.extract(inputs, self.models)
        if not exists(self.spark, self.master.items_path):
            return self.kind.extract(inputs, self.models)
        known = self.master.items().select("item_id", "vector")
        old = known.join(inputs.select("item_id").distinct(), "item_id", "left_semi").select("item_id", self.kind.decode(F.col("vector")).alias("feature"))
        return old.unionByName(self.kind.extract(inputs.join(known.select("item_id"), "item_id", "left_anti"), self.models))

    def _images(self, x: dict) -> DataFrame:
        if "file" in x:
            try:
                found = I.read_files(self.spark, str(x["file"])).select("item_id", "image")
                if not found.limit(1).count():
                    raise InvalidArguments(f"not an image: {x['file']}")
            except InvalidArguments:
                raise
            except Exception as e:
                raise SystemFailure(f"can't read {x['file']}") from e
            return found
        if "data" in x:
            if I.decode(bytes(x["data"])) is None:
                raise InvalidArguments("the data is not an image")
            return I.read_bytes(self.spark.createDataFrame([(bytearray(x["data"]),)], "content binary"))
        return x["image"].select("item_id", "image")

    def resolve(self, x: dict) -> DataFrame:
        """One row (item_id, feature) for an input; item_id is null for a string or raw feature."""
        key = next((k for k in INPUT_KEYS if x.get(k) is not None), None)
        if key is None:
            raise InvalidArguments(f"an input needs one of {', '.join(INPUT_KEYS)}")
        if key in ("file", "data", "image"):
            return self.features(self._images(x))
        if key == "string":
            row = self.spark.range(1).select(F.lit(None).cast("string").alias("item_id"), self.kind.decode(F.lit(str(x["string"]))).alias("feature"))
            if row.where(F.col("feature").isNull()).count():
                raise InvalidArguments("not a feature of this kind")
            return row
        if key == "raw":
            return x["raw"].select(F.lit(None).cast("string").alias("item_id"), "feature")
        self._stored()
        found = self.master.vector(parse_id(x["id"])).select("item_id", self.kind.decode(F.col("vector")).alias("feature"))
        if not found.limit(1).count():
            raise NoData(x["id"])
        return found.limit(1)

    def feature_raw(self, x: dict) -> DataFrame:
        return self.resolve(x)

    def feature_string(self, x: dict) -> str:
        return self.resolve(x).select(self.kind.encode(F.col("feature"))).first()[0]

    # changes

    def insert(self, x: dict | DataFrame) -> list[str] | str:
        """Stores an input, or a table of images; returns its id (or ids). Visible to searches after a pull."""
        self._stored()
        if isinstance(x, dict):
            if x.get("id") is not None and not any(x.get(k) is not None for k in INPUT_KEYS[:-1]):
                raise InvalidArguments("an id alone can't be inserted")
            if x.get("string") is not None or x.get("raw") is not None:
                raise InvalidArguments("only images can be inserted")
            rows = self.features(self._images(x))
        else:
            rows = self.features(x)
        rows = rows.select("item_id", self.kind.encode(F.col("feature")).alias("vector")).cache()
        ids = [r.item_id for r in rows.select("item_id").collect()] if isinstance(x, dict) else None
        self.master.insert(rows)
        rows.unpersist()
        return ids[0] if ids else ids

    def remove(self, ids: DataFrame | str) -> None:
        self._stored()
        self.master.remove(self.spark.createDataFrame([(parse_id(ids),)], "item_id string") if isinstance(ids, (str, bytes)) else ids)

    # search

    def _query_options(self, x: dict) -> dict:
        out = dict(self.options)
        for k in ("color_weight", "color_threshold"):
            if x.get(k) is not None:
                out[k] = O.to_float(x[k])
        if x.get("color_method") is not None:
            out["color_method"] = x["color_method"]
        if isinstance(self.kind, Words) and self.rerank and self.models.idf is not None:
            out["weights"] = F.col("weights_")
        return out

    def search_many(self, queries: DataFrame, n: int, options: dict | None = None) -> DataFrame:
        """(query_id, rank, item_id, similarity) for queries (query_id, feature)."""
        self._stored()
        if n < 1:
            raise InvalidArguments("n is at least 1")
        if self.sync_first:
            self.pull()
        options = self._query_options(options or {})
        items = topk.live(self.index.items()).select("item_id", self.kind.decode(F.col("vector")).alias("item_"))
        if self.storage == "index":
            return self._index_search(queries, n, options)
        asked = OVERFETCH * n if options["strip"] else n
        queries = queries.select("query_id", F.col("feature").alias("query_"))
        if "weights" in options:  # the weights of a model's words: a table of fixed size, as one map
            queries = queries.crossJoin(F.broadcast(self.models.idf.agg(F.map_from_entries(F.collect_list(F.struct(F.col("word").cast("long"), F.col("weight").cast("double")))).alias("weights_"))))
        score, first = self.kind.score(F.col("query_"), F.col("item_"), options), self.kind.first(F.col("query_"), F.col("item_"), options)
        if first is not None:
            kept = topk.topk_many(items, queries, first, max(10 * asked, 100)).drop("rank", "similarity")
            from pyspark.sql import Window

            w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col("item_id").asc())
            found = kept.withColumn("similarity", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= asked)
        else:
            found = topk.topk_many(items, queries, score, asked)
        found = found.select("query_id", "rank", "item_id", F.col("similarity").cast("double").alias("similarity"))
        return strip(found, "query_id").where(F.col("rank") <= n) if options["strip"] else found

    def _index_search(self, queries: DataFrame, n: int, options: dict) -> DataFrame:
        """Reads the stored postings of the queries' words, and the words of the items that share enough of them."""
        asked = queries.select(F.col("query_id").alias("query"), F.explode("feature.words").alias("word"))
        items = self.index.items()
        stored = self.postings.items()
        if stored is None:
            return self.spark.createDataFrame([], "query_id long, rank int, item_id string, similarity double")
        gone = items.where(F.col("flag").bitwiseAND(1) != 0).select(F.col("item_id").alias("item"))
        posts = self.postings.near(asked).join(gone, "item", "left_anti")
        if self.rerank and self.models.idf is not None:
            idf = F.broadcast(self.models.idf.select(F.col("word").alias("w_"), "weight"))
            plain = inverted.unflagged(F.col("word")) if self.kind.split else F.col("word")
            weights = asked.select("word").distinct().withColumn("w_", plain).join(idf, "w_").select("word", "weight")
            hits = posts.join(asked.where("word is not null"), "word").groupBy("query", "item").count().where(F.col("count") > max(1, options["hit_threshold"]))
            words = items.select(F.col("item_id").alias("item"), "vector").join(hits.select("item").distinct(), "item", "left_semi")
            words = words.select("item", F.explode(self.kind.decode(F.col("vector"))["words"]).alias("word")).withColumn("w_", plain)
            norms = words.join(idf, "w_").groupBy("item").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
        else:
            weights = asked.select("word").distinct().select("word", F.lit(1.0).alias("weight"))
            norms = stored.select("item", F.sqrt(F.col("n_words").cast("double")).alias("norm"))
        found = inverted.index_topk(posts, weights, asked, n, options["hit_threshold"], norms)
        return found.select(F.col("query").alias("query_id"), "rank", F.col("item").alias("item_id"), "similarity")

    def search(self, n: int, x: dict) -> DataFrame:
        """(rank, item_id, similarity) of the n most similar live items."""
        self._stored()
        query = self.resolve(x).select(F.lit(0).alias("query_id"), "feature")
        return self.search_many(query, n, x).select("rank", "item_id", "similarity").orderBy("rank")

    def similarity(self, a: dict, b: dict) -> float:
        """Of two inputs; options come from the first."""
        left, right = self.resolve(a).select(F.col("feature").alias("a_")), self.resolve(b).select(F.col("feature").alias("b_"))
        pair = left.crossJoin(right)
        options = self._query_options(a)
        if "weights" in options:
            pair = pair.crossJoin(F.broadcast(self.models.idf.agg(F.map_from_entries(F.collect_list(F.struct(F.col("word").cast("long"), F.col("weight").cast("double")))).alias("weights_"))))
        return float(pair.select(self.kind.score(F.col("a_"), F.col("b_"), options)).first()[0])

    # run-time options and methods

    def set(self, key: str, value) -> None:
        if key not in ("color_weight", "strip"):
            raise InvalidArguments(f"can't set {key!r}")
        self.options[key] = O.to_float(value) if key == "color_weight" else O.to_bool(value)

    def get(self, key: str) -> float:
        if key != "color_weight":
            raise InvalidArguments(f"can't get {key!r}")
        return self.options[key]

    def unset(self, key: str) -> None:
        if key not in ("color_weight", "strip"):
            raise InvalidArguments(f"can't unset {key!r}")
        self.options[key] = self.kind.color_weight if key == "color_weight" else False

    def invoke(self, method: str, x: dict | None = None):
        """update_idf (bitmaps): weights from the stored items; print_idf (index): them as a table; save_idf: to a path."""
        if not isinstance(self.kind, Words) or self.storage == "none" or method not in ("update_idf", "save_idf", "print_idf") or method == ("print_idf" if self.storage == "dense" else "update_idf"):
            raise InvalidArguments(f"{self.name} has no method {method!r}")
        stop = O.to_int((x or {}).get("stopword_th", 0))
        items = self.index.items().select(F.col("item_id").alias("item"), self.kind.decode(F.col("vector")).alias("f"))
        words = F.array_distinct(F.transform("f.words", lambda w: inverted.unflagged(w))) if self.kind.split else F.col("f.words")
        n = items.count()
        universe = self.spark.range(self.kind.size).select(F.col("id").alias("word"))
        df = inverted.doc_freq(items.select("item", F.explode(words).alias("word")), universe)
        weights = df.select("word", "df", inverted.idf(F.col("df"), F.lit(n), stop).alias("weight"))
        if method == "save_idf":
            weights.write.mode("overwrite").parquet(str((x or {})["path"]))
        elif method == "update_idf":
            self.models.idf = weights.select("word", "weight")
        return weights


def ids_of_file(path: str) -> str:
    try:
        with open(path, "rb") as f:
            return content_id_of(f.read())
    except OSError as e:
        raise SystemFailure(str(e)) from e


__all__ = ["Engine", "Metric", "Models", "ids_of_file"]
