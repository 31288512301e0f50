"""Metadata tables: pure table operators, and their Parquet home.

Writes only ever append. A changed record is a newer row, a deletion a row in
``deletions``; readers keep the latest row per key. So no write reads and
overwrites the same path, and a lost executor leaves nothing half written.

A table's folder has ``batches`` (one folder per append), ``generations`` and
``manifests``. ``compact`` writes all rows as a new generation, partitioned by a
hash of the key that lookups ask for, and then one manifest that names the
generation and the batches in it. Readers take the newest manifest whose
generation is whole, and the batches that it does not name; a compaction lost on
the way leaves a folder that no manifest names. Lookups by key read one of the
generation's partitions. ``clean`` removes what the newest manifest replaces.
"""

from __future__ import annotations

import json
import secrets
import time
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tabloom.functions.records import list_to_json, login_key

# Names and fields of the stored records.
SCHEMAS = {
    "users": "id long, email string, password_hash string, full_name string, created_at timestamp",
    "datasets": "id long, user_id long, filename string, original_name string, file_path string, "
    "num_rows long, num_cols long, file_size long, uploaded_at timestamp",
    "model_configs": "id long, dataset_id long, user_id long, target_column string, problem_type string, "
    "excluded_columns string, configured_at timestamp",
    "preprocessing_results": "id long, dataset_id long, user_id long, summary_json string, x_train_path string, "
    "x_test_path string, scaler_path string, encoder_path string, "
    "training_result_path string, preprocessed_at timestamp",
    "prediction_history": "batch long, id long, user_id long, dataset_id long, dataset_name string, user_name string, "
    "selected_model string, prediction_result string, confidence_score double, created_at timestamp",
    "deletions": "entity string, id long, user_id long, deleted_at timestamp",
}

# The column that a table's lookups ask for, and for tables with one valid row per key what makes a row newest.
LOOKUPS = {"users": "email", "datasets": "id", "model_configs": "dataset_id", "preprocessing_results": "dataset_id",
           "prediction_history": "user_id", "deletions": "entity"}
NEWEST = {"model_configs": ["configured_at", "id"], "preprocessing_results": ["preprocessed_at", "id"]}
# Partitions of a generation, and tasks that write a partition's rows, as one key may hold a third of them.
PARTITIONS, WRITERS = 32, 4


def latest_per_key(rows: DataFrame, key: list[str], newest: list[str]) -> DataFrame:
    """One row per key, the newest. The rank is limited before the shuffle."""
    order = Window.partitionBy(*key).orderBy(*[F.col(n).desc_nulls_last() for n in newest])
    return rows.withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__rank")


def upsert_latest(current: DataFrame, changes: DataFrame, key: list[str], newest: list[str]) -> DataFrame:
    return latest_per_key(current.unionByName(changes), key, newest)


def insert_if_absent(current: DataFrame, batch: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows of ``batch`` that may be added: first of their key, key not taken."""
    first = Window.partitionBy("__key").orderBy(*order)
    fresh = (
        batch.withColumn("__key", login_key(F.col(key)))
        .withColumn("__rank", F.row_number().over(first))
        .where("__rank = 1")
        .drop("__rank")
    )
    taken = current.select(login_key(F.col(key)).alias("__key"))
    return fresh.join(taken, "__key", "left_anti").withColumn(key, F.col("__key")).drop("__key")


def delete_owned(rows: DataFrame, requests: DataFrame, keys: list[str]) -> DataFrame:
    """Rows left after deleting those asked for by their owner."""
    return rows.join(requests.select(*keys), keys, "left_anti")


def delete_children(children: DataFrame, parents: DataFrame, requests: DataFrame,
                    keys: list[str], child_key: str) -> DataFrame:
    """Rows of a dependent table left after the parents' deletion."""
    gone = parents.join(requests.select(*keys), keys, "left_semi").select(F.col(keys[0]).alias(child_key))
    return children.join(gone, child_key, "left_anti")


def dataset_record(df: DataFrame, user_id: int, filename: str, original_name: str, file_path: str,
                   file_size: int) -> DataFrame:
    """Registration row of a table: who, where, how many rows and columns."""
    return df.agg(F.count(F.lit(1)).alias("num_rows")).select(
        F.lit(user_id).cast("long").alias("user_id"),
        F.lit(filename).alias("filename"),
        F.lit(original_name).alias("original_name"),
        F.lit(file_path).alias("file_path"),
        "num_rows",
        F.lit(len(df.columns)).cast("long").alias("num_cols"),
        F.lit(file_size).cast("long").alias("file_size"),
    )


def prediction_rows(scored: DataFrame, user_id, dataset_id, dataset_name, user_name, model,
                    prediction: str = "prediction", confidence: str = "confidence") -> DataFrame:
    """Scored rows in the shape of the prediction log."""
    return scored.select(
        user_id.cast("long").alias("user_id"),
        dataset_id.cast("long").alias("dataset_id"),
        dataset_name.alias("dataset_name"),
        user_name.alias("user_name"),
        model.alias("selected_model"),
        F.col(prediction).cast("string").alias("prediction_result"),
        F.col(confidence).cast("double").alias("confidence_score"),
    )


def new_id() -> int:
    """Time-ordered 63-bit id: microseconds, then twelve random bits."""
    return (time.time_ns() // 1000) * 4096 + secrets.randbelow(4096)


class MetadataStore:
    """The metadata tables as Parquet folders below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _append(self, table: str, rows: DataFrame) -> None:
        names = [part.split()[0] for part in SCHEMAS[table].split(", ")]
        rows.select(*names).write.parquet(f"{self.root}/{table}/batches/{new_id()}")

    def _path(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _whole(self, folder: str) -> list[str]:
        """Names of the folders below that were written to their end, oldest first."""
        system, at = self._path(folder)
        if not system.exists(at):
            return []
        names = [status.getPath().getName() for status in system.listStatus(at)]
        return sorted((n for n in names if system.exists(self._path(f"{folder}/{n}/_SUCCESS")[1])), key=int)

    def _manifest(self, table: str) -> dict:
        """The newest manifest whose generation is there, else that of an empty one."""
        system, at = self._path(f"{self.root}/{table}/manifests")
        names = [s.getPath().getName() for s in system.listStatus(at)] if system.exists(at) else []
        whole = set(self._whole(f"{self.root}/{table}/generations"))
        for name in sorted((n.removesuffix(".json") for n in names if n.endswith(".json") and not n.startswith((".", "_"))), key=int, reverse=True):
            if name in whole:
                stream = system.open(self._path(f"{self.root}/{table}/manifests/{name}.json")[1])
                try:
                    return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
                finally:
                    stream.close()
        return {"generation": None, "batches": []}

    def _raw(self, table: str, key=None) -> DataFrame:
        """All rows, or with ``key`` at least all rows of that key: of the generation, only its partition."""
        manifest, schema = self._manifest(table), SCHEMAS[table]
        done = set(manifest["batches"])
        fresh = [f"{self.root}/{table}/batches/{n}" for n in self._whole(f"{self.root}/{table}/batches") if n not in done]
        rows = self.spark.read.schema(schema).parquet(*fresh) if fresh else self.spark.createDataFrame([], schema)
        if manifest["generation"] is not None:
            old = self.spark.read.schema(f"{schema}, partition int").parquet(
                f"{self.root}/{table}/generations/{manifest['generation']}")
            if key is not None:
                old = old.where(F.col("partition") == self._partition(F.lit(key)))
            rows = rows.unionByName(old.drop("partition"))
        return rows

    @staticmethod
    def _partition(key):
        """Texts by their characters, numbers by their value."""
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(PARTITIONS)).cast("int")

    def compact(self, table: str) -> int:
        """Write the table's rows as a new generation and make it valid; the generation's number."""
        manifest = self._manifest(table)
        batches = self._whole(f"{self.root}/{table}/batches")
        rows = self._raw(table)
        if table in NEWEST:
            rows = latest_per_key(rows, [LOOKUPS[table]], NEWEST[table])
        number = new_id()
        rows = rows.withColumn("partition", self._partition(F.col(LOOKUPS[table])))
        rows.repartition("partition", F.pmod(F.xxhash64(*rows.columns[:-1]), F.lit(WRITERS))).sortWithinPartitions(
            "partition", LOOKUPS[table]).write.partitionBy("partition").parquet(f"{self.root}/{table}/generations/{number}")
        text = json.dumps({"generation": str(number), "batches": sorted({*manifest["batches"], *batches}, key=int)})
        self._publish(table, number, text)
        return number

    def _publish(self, table: str, number: int, text: str) -> None:
        """A manifest appears whole or not at all: it is written beside its name and renamed."""
        system, beside = self._path(f"{self.root}/{table}/manifests/.{number}")
        out = system.create(beside, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if not system.rename(beside, self._path(f"{self.root}/{table}/manifests/{number}.json")[1]):
            raise OSError(f"manifest {number} of {table} could not be published")

    def clean(self, table: str) -> None:
        """Remove batches and generations that the newest manifest replaces; no reader may be at work on older ones."""
        manifest = self._manifest(table)
        system, _ = self._path(self.root)
        for name in manifest["batches"]:
            system.delete(self._path(f"{self.root}/{table}/batches/{name}")[1], True)
        for name in self._whole(f"{self.root}/{table}/generations"):
            if manifest["generation"] is not None and int(name) < int(manifest["generation"]):
                system.delete(self._path(f"{self.root}/{table}/generations/{name}")[1], True)
                system.delete(self._path(f"{self.root}/{table}/manifests/{name}.json")[1], True)

    def _one(self, table: str, **values) -> int:
        stamp = {n: datetime.now(timezone.utc) for n in
                 ("created_at", "uploaded_at", "configured_at", "preprocessed_at") if n in SCHEMAS[table]}
        row = {"id": new_id(), **stamp, **values}
        names = [part.split()[0] for part in SCHEMAS[table].split(", ")]
        self._append(table, self.spark.createDataFrame([tuple(row.get(n) for n in names)], SCHEMAS[table]))
        return row["id"]

    def users(self, email: str | None = None) -> DataFrame:
        return self._raw("users", email)

    def datasets(self, dataset_id: int | None = None) -> DataFrame:
        gone = self._raw("deletions", "dataset").where("entity = 'dataset'").select("id", "user_id")
        return delete_owned(self._raw("datasets", dataset_id), gone, ["id", "user_id"])

    def _of_live_datasets(self, rows: DataFrame, dataset_id: int | None = None) -> DataFrame:
        gone = self._raw("deletions", "dataset").where("entity = 'dataset'")
        return delete_children(rows, self._raw("datasets", dataset_id), gone, ["id", "user_id"], "dataset_id")

    def configs(self, dataset_id: int | None = None) -> DataFrame:
        """Valid configurations; with ``dataset_id`` at least that dataset's."""
        latest = latest_per_key(self._raw("model_configs", dataset_id), ["dataset_id"], NEWEST["model_configs"])
        gone = self._raw("deletions", "config").where("entity = 'config'").select(
            F.col("id").alias("dataset_id"), "user_id", "deleted_at")
        kept = latest.join(
            gone, (latest.dataset_id == gone.dataset_id) & (latest.user_id == gone.user_id)
            & (gone.deleted_at >= latest.configured_at), "left_anti")
        return self._of_live_datasets(kept, dataset_id)

    def results(self, dataset_id: int | None = None) -> DataFrame:
        latest = latest_per_key(
            self._raw("preprocessing_results", dataset_id), ["dataset_id"], NEWEST["preprocessing_results"])
        return self._of_live_datasets(latest, dataset_id)

    def predictions(self, user_id: int | None = None) -> DataFrame:
        """The prediction log; with ``user_id`` at least that user's rows."""
        return self._of_live_datasets(self._raw("prediction_history", user_id))

    def create_user(self, email: str, password_hash: str, full_name: str) -> int | None:
        """New user id, or None when the address is taken (one writer at a time)."""
        key = email.lower().strip()
        if self.users(key).where(F.col("email") == key).limit(1).count():
            return None
        return self._one("users", email=key, password_hash=password_hash, full_name=full_name.strip())

    def save_dataset(self, user_id: int, filename: str, original_name: str, file_path: str,
                     num_rows: int, num_cols: int, file_size: int) -> int:
        return self._one("datasets", user_id=user_id, filename=filename, original_name=original_name,
                         file_path=file_path, num_rows=num_rows, num_cols=num_cols, file_size=file_size)

    def register(self, df: DataFrame, user_id: int, filename: str, original_name: str, file_path: str,
                 file_size: int) -> int:
        """Register a table with the shape Spark counts."""
        row = dataset_record(df, user_id, filename, original_name, file_path, file_size).first()
        return self.save_dataset(**row.asDict())

    def save_config(self, dataset_id: int, user_id: int, target_column: str, problem_type: str = "auto",
                    excluded: list[str] = ()) -> int:
        text = self.spark.range(1).select(
            list_to_json(F.array(*[F.lit(n) for n in excluded]).cast("array<string>"))).first()[0]
        return self._one("model_configs", dataset_id=dataset_id, user_id=user_id, target_column=target_column,
                         problem_type=problem_type, excluded_columns=text)

    def save_result(self, dataset_id: int, user_id: int, summary_json: str, **paths) -> int:
        return self._one("preprocessing_results", dataset_id=dataset_id, user_id=user_id,
                         summary_json=summary_json, **paths)

    def log_predictions(self, rows: DataFrame) -> None:
        """Append scored rows (see ``prediction_rows``); a row is named by its batch and its number in the batch."""
        names = rows.columns
        self._append("prediction_history", rows.select(
            F.lit(new_id()).alias("batch"), F.monotonically_increasing_id().alias("id"), *names,
            F.lit(datetime.now(timezone.utc)).cast("timestamp").alias("created_at")))

    def _delete(self, entity: str, key: int, user_id: int) -> None:
        self._append("deletions", self.spark.createDataFrame(
            [(entity, key, user_id, datetime.now(timezone.utc))], SCHEMAS["deletions"]))

    def delete_dataset(self, dataset_id: int, user_id: int) -> None:
        self._delete("dataset", dataset_id, user_id)

    def delete_config(self, dataset_id: int, user_id: int) -> None:
        self._delete("config", dataset_id, user_id)

    def user_by_email(self, email: str) -> DataFrame:
        key = email.lower().strip()
        return self.users(key).where(F.col("email") == key)

    def user_by_id(self, user_id: int) -> DataFrame:
        return self.users().where(F.col("id") == user_id)

    def dataset_by_id(self, dataset_id: int, user_id: int) -> DataFrame:
        return self.datasets(dataset_id).where((F.col("id") == dataset_id) & (F.col("user_id") == user_id))

    def config_of(self, dataset_id: int) -> DataFrame:
        return self.configs(dataset_id).where(F.col("dataset_id") == dataset_id)

    def result_of(self, dataset_id: int) -> DataFrame:
        return self.results(dataset_id).where(F.col("dataset_id") == dataset_id)
