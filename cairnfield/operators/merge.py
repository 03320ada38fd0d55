"""Changes to layers as pure functions: each takes the table as it was and returns it as it will be.

Parquet tables have no row-level MERGE, so a change is read, joined and written as a new version; layers are
partitions by `source`, and replace_layer() writes only its own. Every function here gives the same result when it
is applied twice, except the plain append.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnfield.functions import docs
from cairnfield.session import cut


def _same(keys: Sequence[str], left: str = "was", right: str = "new") -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}") == F.col(f"{right}.{k}") for k in keys])


def append(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows, allowMissingColumns=True)


def last_of(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row a key, the last in the given order; a batch must be this before it is merged."""
    w = Window.partitionBy(*keys).orderBy(*[o.desc() for o in order])
    return rows.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """The rows with their number from 1 in an order of unique keys: ranges of the order are numbered apart, behind the counts of those before."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    # a row a partition: no more than their number
    before = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ranged.groupBy("_part").count().select(F.col("_part").alias("_of"), before.alias("_before"))
    number = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_before")
    return ranged.join(F.broadcast(offsets), F.col("_part") == F.col("_of")).withColumn(name, number).drop("_part", "_of", "_before")


def numbered_behind(table: DataFrame, rows: DataFrame, *order: str) -> DataFrame:
    """The rows with new ids behind the table's greatest one, in an order of unique keys."""
    top = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    return numbered(rows, "id", *order).join(F.broadcast(top), F.lit(True)).withColumn("id", (F.col("id") + F.col("_top")).cast("long")).drop("_top")


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str], replace: bool = True, action: str | None = None) -> DataFrame:
    """Keyed merge. Rows whose key is in the table overwrite its columns they have (all rows of that key), unless `replace` is
    off; others, and those with a null or empty key, are added. `action` names a column with updated, inserted or kept. Of several rows of one key in a
    batch one counts, the greatest as JSON text; last_of() chooses by another order before."""
    columns = table.columns
    given = [c for c in rows.columns if c in columns and c not in keys]
    usable = reduce(lambda a, b: a & b, [F.col(k).isNotNull() & (F.col(k).cast("string") != "") for k in keys])
    unkeyed = rows.filter(~usable | usable.isNull())
    rows = last_of(rows.filter(usable), keys, [F.to_json(F.struct(*rows.columns))])
    new = rows.withColumn("_there", F.lit(True))
    joined = table.alias("was").join(new.alias("new"), _same(keys), "left")
    hit = F.col("new._there").isNotNull()
    updated = joined.select(*[F.when(hit, F.col(f"new.{c}")).otherwise(F.col(f"was.{c}")).alias(c) if replace and c in given else F.col(f"was.{c}").alias(c) for c in columns], F.when(hit & F.lit(replace), "updated").otherwise("kept").alias("_action"))
    added = rows.alias("new").join(table.select(*keys).distinct().alias("was"), _same(keys), "left_anti").unionByName(unkeyed)
    added = added.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(table.schema[c].dataType).alias(c) for c in columns], F.lit("inserted").alias("_action"))
    out = updated.unionByName(added)
    return out.withColumnRenamed("_action", action) if action else out.drop("_action")


def upsert_drawn(table: DataFrame, drawn: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merges drawn features (source, id, name, geometry, properties JSON, custom_data JSON or null) into the feature table.

    A feature is matched by (id, source) first, which stamps _draw_id := id, then by (source, _draw_id); a new one
    without _draw_id gets one from its content. custom_data is replaced only where given. Returns the new table and audit rows (action,
    source, entity_id).
    """
    props = docs.doc("properties")
    fresh = drawn.withColumns({"_doc": props, "_draw": docs.field(props, "_draw_id")})
    ids = table.select(F.col("source").alias("of"), F.col("id").alias("known")).distinct()
    fresh = fresh.join(ids, (F.col("source") == F.col("of")) & (F.col("id") == F.col("known")), "left")
    by_id = F.col("known").isNotNull()
    key = F.when(by_id, F.col("id").cast("string")).otherwise(F.coalesce(F.nullif(F.col("_draw"), F.lit("")), F.substring(F.md5(F.concat_ws("|", "source", "name", "properties")), 1, 12)))
    fresh = fresh.withColumn("_draw", key).withColumn("properties", docs.text(docs.put(F.col("_doc"), "_draw_id", F.col("_draw")))).withColumn("_by_id", by_id).drop("_doc", "of", "known")
    # a join for each way of matching, on all of its keys: on the source alone a layer would meet itself in a task
    fresh = cut(fresh)
    was = table.withColumn("_key", docs.field(docs.doc("properties"), "_draw_id"))
    own, drawn_as = _same(["source", "id"]), (F.col("was.source") == F.col("new.source")) & (F.col("was._key") == F.col("new._draw"))
    ways = [(fresh.filter("_by_id").alias("new"), own), (fresh.filter("not _by_id").alias("new"), drawn_as)]
    take = lambda c, keep: (F.coalesce(F.col(f"new.{c}"), F.col(f"was.{c}")) if keep else F.col(f"new.{c}")).alias(c)
    changing = {"name": False, "geometry": False, "properties": False, "custom_data": True}
    taken = [take(c, changing[c]) if c in changing and c in drawn.columns else F.col(f"was.{c}") for c in table.columns]
    updated = reduce(DataFrame.unionByName, [was.alias("was").join(new, on).select(*taken) for new, on in ways])
    # rows without a drawing id match none, and would all be sent to their source's task
    left = was.alias("was").join(ways[0][0], own, "left_anti")
    kept = left.filter("_key is null").unionByName(left.filter("_key is not null").alias("was").join(ways[1][0], drawn_as, "left_anti"))
    updated = updated.unionByName(kept.select(*table.columns))
    keyed = was.filter("_key is not null").alias("was")
    hits = ways[0][0].select("source", "_draw").unionByName(ways[1][0].join(keyed, drawn_as, "left_semi").select("source", "_draw"))
    done = hits.filter("_draw is not null").distinct()
    added = fresh.join(done, ["source", "_draw"], "left_anti")
    top = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    inserted = numbered(added, "id", "source", "_draw").join(F.broadcast(top), F.lit(True)).withColumn("id", (F.col("id") + F.col("top")).cast("long"))
    inserted = inserted.select(*[F.coalesce(F.col(c), F.lit("{}")).alias(c) if c == "custom_data" else F.col(c) if c in inserted.columns else F.lit(None).cast(table.schema[c].dataType).alias(c) for c in table.columns], "_draw")
    audit = done.select(F.lit("update").alias("action"), "source", F.col("_draw").alias("entity_id")).unionByName(inserted.select(F.lit("insert").alias("action"), "source", F.col("_draw").alias("entity_id")))
    return updated.unionByName(inserted.drop("_draw")), audit


def replace_layer(table: DataFrame, source: str, rows: DataFrame) -> DataFrame:
    """Full refresh of one layer."""
    return delete(table, F.col("source") == source).unionByName(rows.withColumn("source", F.lit(source)).select(*table.columns))


def write_layer(rows: DataFrame, path: str) -> None:
    """Overwrites only the partitions (layers) that the rows are in."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)


def rebuild(table: DataFrame, source: str, derived: DataFrame) -> DataFrame:
    """A derived layer made anew: its old rows go, the derived ones come; twice is once."""
    return append(delete(table, F.col("source") == source), derived.withColumn("source", F.lit(source)))


def batches(statements: DataFrame, size: int = 30) -> DataFrame:
    """batch, n, script of statements (pos, kind, sql) put together `size` at a time in the order of pos: a delete ends the batch before it, and is one of
    its own, so that it is applied on what came before."""
    w = Window.partitionBy("layer").orderBy("pos")
    flush = (F.col("kind") == "delete") | F.coalesce(F.lag("kind").over(w) == "delete", F.lit(False))
    run = statements.withColumn("_run", F.sum(F.when(flush, 1).otherwise(0)).over(w))
    placed = run.withColumn("_at", F.row_number().over(Window.partitionBy("layer", "_run").orderBy("pos")) - 1)
    grouped = placed.groupBy("layer", "_run", F.floor(F.col("_at") / size).alias("_part")).agg(F.array_sort(F.collect_list(F.struct("pos", "sql"))).alias("s"))
    script = F.array_join(F.transform("s", lambda x: x["sql"]), "\n")
    number = F.row_number().over(Window.partitionBy("layer").orderBy("_run", "_part"))
    return grouped.select("layer", number.alias("batch"), F.size("s").alias("n"), script.alias("script"))


def delete(table: DataFrame, where: Column) -> DataFrame:
    """All but the rows where the predicate is true; where it is null they stay."""
    return table.filter(~F.coalesce(where, F.lit(False)))


def delete_using(table: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return table.join(keys.select(*on).distinct(), list(on), "left_anti")


def update_from(table: DataFrame, values: DataFrame, keys: Sequence[str], columns: dict[str, str] | None = None) -> DataFrame:
    """Columns set from a keyed relation, by the column's name to that of the value; rows without a match keep theirs."""
    columns = columns or {c: c for c in values.columns if c not in keys}
    joined = table.alias("was").join(values.withColumn("_there", F.lit(True)).alias("new"), _same(keys), "left")
    hit = F.col("new._there").isNotNull()
    return joined.select(*[F.when(hit, F.col(f"new.{columns[c]}")).otherwise(F.col(f"was.{c}")).alias(c) if c in columns else F.col(f"was.{c}") for c in table.columns])


def fork(table: DataFrame, layers: DataFrame, layer_id: int) -> tuple[DataFrame, DataFrame, str]:
    """A live layer frozen as the copy static_<layer id>: new table, new layers and `source:count`."""
    found = layers.filter(F.col("id") == layer_id).select("template_slug", "instance_type").head()
    if found is None:
        raise ValueError(f"no layer {layer_id}")
    if found["instance_type"] == "static":
        raise ValueError(f"layer {layer_id} is static already")
    source = f"static_{layer_id}"
    copy = table.filter(F.col("source") == found["template_slug"]).withColumn("source", F.lit(source))
    chosen = F.col("id") == layer_id
    changed = layers.withColumns({"instance_type": F.when(chosen, "static").otherwise(F.col("instance_type")), "static_source": F.when(chosen, source).otherwise(F.col("static_source"))})
    return table.unionByName(copy.select(*table.columns)), changed, f"{source}:{copy.count()}"


def audit_of_changes(before: DataFrame, after: DataFrame, key: str, column: str) -> DataFrame:
    """key, before, after of the rows whose column is distinct between two versions."""
    joined = before.select(key, F.col(column).alias("before")).join(after.select(key, F.col(column).alias("after")), key)
    return joined.filter(~F.col("before").eqNullSafe(F.col("after")))


def merge_photos(meta: Column, fresh: Column, own: str = "google") -> Column:
    """A gallery after an enrichment: entries of other sources in their order, then the fresh ones; null leaves it as it was."""
    kept = F.filter(F.coalesce(meta, F.array().cast("array<struct<url:string,caption:string,source:string>>")), lambda m: ~F.coalesce(m["source"] == own, F.lit(False)))
    return F.when(fresh.isNull(), meta).otherwise(F.concat(kept, fresh))


def approve(table: DataFrame, pending: DataFrame, image_id: int) -> tuple[DataFrame, DataFrame]:
    """Appends a pending image to its feature's photos and photo_meta, and marks it approved. Features are keyed by
    (source, id as text or _draw_id)."""
    image = pending.filter((F.col("id") == image_id) & (F.col("status") == "pending")).select(F.col("feature_source").alias("_source"), F.col("feature_key").alias("_key"), F.col("url").alias("_url"), F.col("caption").alias("_caption"))
    draw = docs.field(docs.doc("properties"), "_draw_id")
    joined = table.join(F.broadcast(image), (F.col("source") == F.col("_source")) & ((F.col("id").cast("string") == F.col("_key")) | (draw == F.col("_key"))), "left")
    hit = F.col("_url").isNotNull()
    one = F.array(F.struct(F.col("_url").alias("url"), F.col("_caption").alias("caption"), F.lit("community").alias("source")))
    out = joined.withColumns(
        {
            "photos": F.when(hit, F.concat(F.coalesce("photos", F.array().cast("array<string>")), F.array("_url"))).otherwise(F.col("photos")),
            "photo_meta": F.when(hit, F.concat(F.coalesce("photo_meta", F.array().cast(one_type := "array<struct<url:string,caption:string,source:string>>")), one.cast(one_type))).otherwise(F.col("photo_meta")),
        }
    )
    status = F.when((F.col("id") == image_id) & (F.col("status") == "pending"), "approved").otherwise(F.col("status"))
    return out.select(*table.columns), pending.withColumn("status", status)


def set_photos(table: DataFrame, source: str, key: str, photos: list[str], meta: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """Replaces a feature's photos, and its photo_meta where given."""
    hit = (F.col("source") == source) & ((F.col("id").cast("string") == key) | F.coalesce(docs.field(docs.doc("properties"), "_draw_id") == key, F.lit(False)))
    out = table.withColumn("photos", F.when(hit, F.array(*map(F.lit, photos)).cast("array<string>")).otherwise(F.col("photos")))
    if meta is None:
        return out
    entries = F.array(*[F.struct(F.lit(u).alias("url"), F.lit(c).alias("caption"), F.lit(s).alias("source")) for u, c, s in meta])
    return out.withColumn("photo_meta", F.when(hit, entries.cast("array<struct<url:string,caption:string,source:string>>")).otherwise(F.col("photo_meta")))


def set_fields(table: DataFrame, values: DataFrame, key: str, document: str = "properties") -> DataFrame:
    """Shallow-merges a JSON patch (column `patch`) into a document column, by key."""
    joined = table.join(values.select(F.col(key).alias("_key"), F.col("patch").alias("_patch")), F.col(key) == F.col("_key"), "left")
    return joined.withColumn(document, F.when(F.col("_patch").isNotNull(), docs.text(docs.merge(docs.doc(document), docs.doc("_patch")))).otherwise(F.col(document))).select(*table.columns)


def apply_enrichment(table: DataFrame, values: DataFrame, as_of: Column, block: str = "google") -> DataFrame:
    """Enrichments (id, props JSON, fresh photos or null, place_id) merged in: fields into properties, photos behind those of other
    sources (null leaves the gallery as it was), and the fetch's facts into custom_data under `block`."""
    joined = table.join(values.select(F.col("id").alias("_id"), F.col("props").alias("_props"), F.col("fresh").alias("_fresh"), F.col("place_id").alias("_place")), F.col("id") == F.col("_id"), "left")
    hit = F.col("_id").isNotNull()
    facts = docs.build(place_id=F.col("_place"), fetched_at=F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss'Z'"), status=F.lit("ok"))
    merged = merge_photos(F.col("photo_meta"), F.col("_fresh"), block)
    out = joined.withColumns(
        {
            "properties": F.when(hit, docs.text(docs.merge(docs.doc("properties"), docs.doc("_props")))).otherwise(F.col("properties")),
            "custom_data": F.when(hit, docs.text(docs.put(docs.doc("custom_data"), block, facts))).otherwise(F.col("custom_data")),
            "photo_meta": F.when(hit, merged).otherwise(F.col("photo_meta")),
            "photos": F.when(hit & F.col("_fresh").isNotNull(), F.transform(merged, lambda m: m["url"])).otherwise(F.col("photos")),
        }
    )
    return out.select(*table.columns)


def submit_pending(pending: DataFrame, images: DataFrame) -> DataFrame:
    """New images (feature_source, feature_key, url, caption, submitter_email) as pending rows; ids follow from their content, so a
    repeated submission is there once; images without a URL are refused."""
    ident = F.xxhash64("feature_source", "feature_key", "url")
    new = images.filter(F.coalesce(F.trim("url"), F.lit("")) != "").withColumns({"id": ident, "status": F.lit("pending"), "caption": F.nullif(F.trim("caption"), F.lit("")), "url": F.trim("url")}).dropDuplicates(["id"])
    return append(pending, new.join(pending.select("id"), "id", "left_anti"))
