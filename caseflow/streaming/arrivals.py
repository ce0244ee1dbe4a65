"""Evidence that arrives batch by batch, added to tables that are looked up by hashed words and not read whole."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.functions import text as t
from caseflow.functions.roles import Roles
from caseflow.operators import extract, resolve
from caseflow.operators.registers import places
from caseflow.operators.work import cut, spread

#: Bits of a filter (what a bitmap of Spark holds), words that share one, hashes of a word: about 1 in 200 absent words passes.
BITS, WORDS, HASHES = 32768, 2500, 4
#: Ids of a batch's entities start at its number times this.
IDS = 1 << 36


class Store:
    """Rows under lookup words (word string, and the columns of ``schema``), in hash buckets of immutable runs.

    A batch writes one run for each bucket that it touches. When a bucket has ``fan`` runs of a level, they and the new rows become one run of the next level, so a bucket has
    fewer than ``fan`` runs of each of logarithmically many levels. Each run has Bloom filters of its words; ``find`` reads the runs whose filters pass a word.
    A batch reads what the batch before it left and writes its own folders anew, so it can be repeated; batches are numbered 0, 1, 2, ...
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, buckets: int = 64, fan: int = 8):
        self.spark, self.root, self.buckets, self.fan = spark, root, buckets, fan
        self.schema = f"word string, {schema}, since long"
        self.files_read: list[int] = []

    def _live(self, batch_id: int) -> list[tuple[int, int, int, int]]:
        """(bucket, batch, level, cells) of the runs before a batch: fewer than buckets x fan x levels."""
        if batch_id <= 0:
            return []
        return [tuple(r) for r in self.spark.read.schema("bucket int, batch long, level int, cells int").parquet(f"{self.root}/runs/{batch_id - 1}").collect()]

    def _bucket(self, word: Column) -> Column:
        return F.pmod(F.xxhash64(word), F.lit(self.buckets)).cast("int")

    @staticmethod
    def _cell(word: Column, cells: Column) -> Column:
        return F.pmod(F.xxhash64(word, F.lit("cell")), cells).cast("int")

    @staticmethod
    def _bits(word: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(word, F.lit(i)), F.lit(BITS)) for i in range(HASHES)]

    def _runs(self, kind: str, schema: str, runs) -> DataFrame:
        paths = [f"{self.root}/{kind}/batch={b}/bucket={k}" for k, b in sorted(runs)]
        if not paths:
            return self.spark.createDataFrame([], f"{schema}, batch long, bucket int")
        return self.spark.read.schema(f"{schema}, batch long, bucket int").option("basePath", f"{self.root}/{kind}").parquet(*paths)

    def find(self, words: DataFrame, batch_id: int) -> DataFrame:
        """The distinct rows (columns of the schema, and since: the batch that wrote them) that batches before ``batch_id`` put under any of ``words`` (word)."""
        live = self._live(batch_id)
        asked = cut(words.filter("word IS NOT NULL").select("word").distinct().withColumn("bucket", self._bucket(F.col("word"))))
        touched = {r.bucket for r in asked.select("bucket").distinct().collect()}
        if not touched:
            self.files_read.append(0)
            return self._runs("rows", self.schema, []).drop("word", "batch", "bucket")
        live = [r for r in live if r[0] in touched]
        hit = []
        if live:
            known = F.broadcast(self.spark.createDataFrame(live, "bucket int, batch long, level int, cells int"))
            probes = asked.join(known, "bucket").withColumn("cell", self._cell(F.col("word"), F.col("cells")))
            filters = self._runs("filters", "cell int, bits binary", [(r[0], r[1]) for r in live])
            here = F.lit(True)
            for p in self._bits(F.col("word")):
                byte = F.conv(F.hex(F.substring("bits", F.floor(p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
                here = here & (F.call_function("shiftright", byte, (p % 8).cast("int")).bitwiseAND(1) == 1)
            hit = [(r.bucket, r.batch) for r in probes.join(filters, ["bucket", "batch", "cell"]).filter(here).select("bucket", "batch").distinct().collect()]
        self.files_read.append(len(hit))
        return self._runs("rows", self.schema, hit).join(asked.select("word"), "word", "left_semi").drop("word", "batch", "bucket").distinct()

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """Put ``rows`` (word, columns of the schema) into the runs of a batch; what it merged stays until the batch after the next."""
        live = self._live(batch_id)
        rows = cut(rows.withColumns({"since": F.lit(batch_id).cast("long"), "bucket": self._bucket(F.col("word"))}))
        levels = defaultdict(list)
        for bucket, batch, level, _ in live:
            levels[bucket, level].append((bucket, batch))
        merged, at = set(), {}
        for r in rows.select("bucket").distinct().collect():
            level = 0
            while len(levels[r.bucket, level]) >= self.fan - 1:
                merged.update(levels[r.bucket, level])
                level += 1
            at[r.bucket] = level
        columns = [c.split()[0] for c in self.schema.split(", ")]
        both = rows.select(*columns, "bucket").unionByName(self._runs("rows", self.schema, merged).select(*columns, "bucket"))
        # a hot bucket's rows are split over tasks by adaptive execution
        both.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/rows/batch={batch_id}")
        words = self._runs("rows", self.schema, [(b, batch_id) for b in at]).select("bucket", "word").distinct()
        sizes = {r.bucket: -(-r.n // WORDS) for r in words.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
        cells = self.spark.createDataFrame(sorted(sizes.items()), "bucket int, cells int")
        spots = words.join(F.broadcast(cells), "bucket").select("bucket", self._cell(F.col("word"), F.col("cells")).alias("cell"), F.explode(F.array(*self._bits(F.col("word")))).alias("p"))
        spots.groupBy("bucket", "cell").agg(F.bitmap_construct_agg("p").alias("bits")).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/filters/batch={batch_id}")
        runs = [r for r in live if r[:2] not in merged] + [(b, batch_id, level, sizes[b]) for b, level in at.items()]
        self.spark.createDataFrame(runs, "bucket int, batch long, level int, cells int").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/runs/{batch_id}")
        # runs that the batch before merged: no batch that can be repeated reads them
        self._delete({r[:2] for r in self._live(batch_id - 1)} - {r[:2] for r in live})

    def _delete(self, runs) -> None:
        jvm = self.spark._jvm
        for bucket, batch in runs:
            for kind in ("rows", "filters"):
                path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{kind}/batch={batch}/bucket={bucket}")
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def rows(self, batch_id: int) -> DataFrame:
        """All rows that are there before a batch, under all their words."""
        return self._runs("rows", self.schema, [r[:2] for r in self._live(batch_id)])


def call_batch(roles: Roles, date: str | None = None):
    return lambda batch: extract.calls(batch, roles, date)


def transfer_batch(roles: Roles, date: str | None = None):
    return lambda batch: extract.transfers(batch, roles, date)


def master_batch(roles: Roles):
    """Entities of master rows, the edges they state and those of the same row."""

    def run(batch):
        rows = extract.master_rows(batch, roles)
        entities = extract.master_entities(rows)
        stated = extract.master_relations(rows, extract.master_lookup(entities))
        edges = stated.unionByName(extract.master_links(rows, stated))
        return entities, edges.select("*", F.lit("").alias("timestamp"), F.lit(None).cast("double").alias("amount"))

    return run


def text_batch(text: str = "content"):
    """Phones, vehicles and accounts of whole texts; texts state no edges here."""

    def run(batch):
        found = extract.pattern_mentions(batch, text).withColumn("ordinal", F.xxhash64("key"))
        nothing = "file string, source string, target string, relation string, timestamp string, amount double"
        return found, batch.sparkSession.createDataFrame([], nothing).withColumn("file", F.col("file").cast(batch.schema["file"].dataType))

    return run


def _word(*parts) -> Column:
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts])


def _own(key: str) -> Column:
    """A key as that of its case."""
    return F.concat(F.coalesce(F.col("case_id").cast("string"), F.lit("")), F.lit("|"), F.col(key))


def _links(edges: DataFrame) -> DataFrame:
    """(case_id, source, target, id): each end of an edge, as it is known in its case, and the other end as it came, where this is an identifier."""
    ends = F.explode(F.array(F.struct(_own("source").alias("source"), F.col("came_target").alias("target")), F.struct(_own("target").alias("source"), F.col("came_source").alias("target"))))
    out = edges.select("case_id", ends.alias("e"), _edge().alias("id")).select("case_id", "e.source", "e.target", "id")
    return out.filter(resolve.identifier_of(F.col("target"))[0].isNotNull())


def _edge() -> Column:
    return _word("e", *[F.col(c) for c in ("case_id", "source", "target", "relation", "timestamp")])


class Evidence:
    """Entities and edges of arriving evidence, whatever its kind; ``handler`` gives the function for ``streams.ingest``.

    Entities of a batch are resolved one after the other (``resolve.arrive``: by file and ordinal) against those of earlier batches that share a key, name or identifier with
    them; matches fill in what the known entity lacks, all others are added, and edges go to the entities that their ends became. Edges that are
    there already are not added. Keys and edges belong to their case; rows without a case belong to case 0. Only the runs that may hold such rows are read (see ``Store``).
    """

    ENTITY = "case_id long, id long, key string, label string, name string, phone string, email string, account string, vehicle string, identifier string"
    EDGE = "case_id long, source string, target string, relation string, timestamp string, amount double, came_source string, came_target string"

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, fan: int = 8):
        self._entities = Store(spark, f"{root}/entities", self.ENTITY, buckets, fan)
        self._edges = Store(spark, f"{root}/edges", self.EDGE, buckets, fan)
        self.spark = spark

    def entities(self, batches: int) -> DataFrame:
        """The entities after so many batches."""
        return self._newest(self._entities.rows(batches))

    def edges(self, batches: int) -> DataFrame:
        """The edges after so many batches, with the ends that they came with."""
        return self._edges.rows(batches).filter("word LIKE 'e|%'").drop("word", "since", "batch", "bucket")

    @staticmethod
    def _newest(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in ("word", "since", "batch", "bucket", "id")]
        return rows.groupBy("id").agg(F.max_by(F.struct(*rest), "since").alias("e")).select("id", "e.*")

    @staticmethod
    def _words(entities: DataFrame) -> DataFrame:
        """(id, word): the key, and what else an entity can be found by."""
        c, label = F.col, F.lower("label")
        key = entities.select("id", _word("id", c("case_id"), c("key")).alias("word"))
        values = resolve.signals(resolve.persons(entities)).select("id", _word("v", c("case_id"), c("kind"), c("value")).alias("word"))
        names = resolve.persons(entities).filter(t.name(c("name")) != "").select("id", _word("n", c("case_id"), label, t.name(c("name"))).alias("word"))
        others = resolve.known_by(entities).select("id", _word("i", c("case_id"), c("label"), c("v")).alias("word"))
        return key.unionByName(values).unionByName(names).unionByName(others)

    def handler(self, extracted):
        """A function of (batch, batch_id). extracted: batch -> (entities, edges), as ``call_batch`` and the others make it; the batch has case_id, file, ordinal."""
        c = F.col

        def handle(batch: DataFrame, batch_id: int) -> None:
            # a few new files are few tasks
            batch = cut(spread(batch))
            cases = batch.select("file", F.coalesce("case_id", F.lit(0)).alias("case_id")).distinct()
            entities, edges = (df.join(cases, "file") for df in extracted(batch))
            email = c("email") if "email" in entities.columns else F.lit("")
            came = entities.filter("key IS NOT NULL").select("case_id", "key", "label", "name", F.coalesce(email, F.lit("")).alias("email"), F.struct("file", "ordinal", "key").alias("at"))
            came = extract.first_wins(came, ("case_id", "key"), "at")
            came = places(came.withColumn("all", F.lit(0)), "all", c("at"), c("case_id")).withColumn("id", c("place") + F.lit(batch_id * IDS))
            new = cut(came.select("case_id", "id", "key", "label", "name", "email", *[F.lit("").alias(k) for k in resolve.KINDS if k != "email"]))
            came_edges = edges.filter("source <> target").select("case_id", "source", "target", "relation", F.coalesce("timestamp", F.lit("")).alias("timestamp"), "amount", c("source").alias("came_source"), c("target").alias("came_target"))
            came_edges = cut(came_edges)
            links, scoped = _links(came_edges), new.withColumn("key", _own("key"))

            # edges that give a value to somebody, those whom they give it to, and all values of these
            if resolve.persons(new).isEmpty():
                values = self.spark.createDataFrame([], "word string")
            else:
                values = resolve.signals(resolve.persons(scoped), links).select(_word("v", c("case_id"), c("kind"), c("value")).alias("word")).distinct()
            giving = _links(self._edges.find(values, batch_id))
            holders = giving.select(_word("id", c("case_id"), F.expr("substring(source, instr(source, '|') + 1)")).alias("word"))
            old = cut(self._newest(self._entities.find(self._words(new).select("word").union(values).union(holders), batch_id)))
            # edges give values to persons only
            keyed = resolve.persons(old).select("case_id", "key").union(resolve.persons(new).select("case_id", "key")).select(_word("k", c("case_id"), c("key")).alias("word"))
            old_links = cut(_links(self._edges.find(keyed.union(values), batch_id)))
            existing = old.withColumn("key", _own("key")).select(*scoped.columns)
            verdicts = cut(resolve.arrive(existing, scoped, old_links, links))
            after = cut(resolve.after_arrival(existing, scoped, verdicts).withColumn("key", F.expr("substring(key, instr(key, '|') + 1)")))

            changed = after.filter("side = 1 OR merged > 0").select(*new.columns)
            self._entities.add(self._words(changed).join(changed, "id"), batch_id)
            became = verdicts.select("id", F.coalesce("candidate_id", "id").alias("to_id"), F.coalesce(c("candidate_new").cast("int"), F.lit(1)).alias("to_side"))
            became = became.join(after.select(c("id").alias("to_id"), c("side").alias("to_side"), c("key").alias("to")), ["to_id", "to_side"]).join(new.select("id", "case_id", "key"), "id")
            ends = came_edges
            for side in ("source", "target"):
                to = became.select(c("case_id").alias("of"), c("key").alias("old"), c("to").alias("became"))
                ends = ends.join(to, ends.case_id.eqNullSafe(to.of) & (ends[side] == to.old), "left").withColumn(side, F.coalesce("became", side)).drop("of", "old", "became")
            ends = cut(ends.filter("source <> target"))
            there = self._edges.find(ends.select(_edge().alias("word")), batch_id)
            fresh = resolve.upsert_edges(there, ends)
            words, given = [_edge()], fresh
            for end, other in (("source", "came_target"), ("target", "came_source")):
                kind, value = resolve.identifier_of(c(other))
                given = given.withColumns({f"{end}_kind": kind, f"{end}_value": value})
                known = c(f"{end}_kind").isNotNull() & (c(f"{end}_value") != "")
                words += [F.when(known, w) for w in (_word("k", c("case_id"), c(end)), _word("v", c("case_id"), c(f"{end}_kind"), c(f"{end}_value")))]
            self._edges.add(given.select(*fresh.columns, F.explode(F.array_distinct(F.array(*words))).alias("word")).filter("word IS NOT NULL"), batch_id)

        return handle
