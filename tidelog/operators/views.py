"""Views: projection of state, upsert and deletion by key, listing and paging, the JSON codec."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.errors import DomainError
from ..functions.schemas import VIEW


class BadCursor(DomainError): ...


def project(states: DataFrame, *fields: str) -> DataFrame:
    """The built-in projection of states (entity_id, entity_type, ...): pk is type#id, sk VIEW, the payload the JSON of
    ``fields``, no ttl. States without an id give none."""
    rows = states.where("coalesce(entity_id, '') <> ''")
    return rows.select(
        C.view_pk().alias("pk"), F.lit(C.DEFAULT_SK).alias("sk"), "entity_id", "entity_type", C.to_json(F.struct(*fields)).alias("payload"),
        F.lit(None).cast("long").alias("ttl")
    )


def keyed(views: DataFrame) -> DataFrame:
    """Views with a blank sk set to VIEW; rows without a pk are none."""
    return views.where("pk is not null").withColumn("sk", F.when(F.coalesce("sk", F.lit("")) == "", C.DEFAULT_SK).otherwise(F.col("sk")))


def upsert(current: DataFrame, incoming: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Last write wins by (pk, sk); incoming (VIEW and ``arrival``) over current. Summed per task before the shuffle."""
    rest = ["entity_id", "entity_type", "payload", "ttl"]
    old = keyed(current).select("pk", "sk", F.lit(0).alias("__new"), F.lit(0).cast("long").alias("__at"), *rest)
    new = keyed(incoming).select("pk", "sk", F.lit(1).alias("__new"), F.col(arrival).cast("long").alias("__at"), *rest)
    return old.unionByName(new).groupBy("pk", "sk").agg(F.max_by(
        F.struct(*rest), F.struct("__new", "__at")
    ).alias("v")).select("pk", "sk", "v.*")


def delete(current: DataFrame, keys: DataFrame) -> DataFrame:
    """Without the views of ``keys`` (pk, sk; a blank sk is VIEW)."""
    return current.join(keyed(keys).select("pk", "sk").distinct(), ["pk", "sk"], "left_anti")


def get(views: DataFrame, pk: str) -> DataFrame:
    """The view with this pk and sk VIEW; no row if there is none."""
    return views.where((F.col("pk") == pk) & (F.col("sk") == C.DEFAULT_SK))


def batch_get(views: DataFrame, keys: DataFrame) -> DataFrame:
    """The views of a list of pks; blanks and repeats in the list are skipped, missing ones left out."""
    wanted = keys.where("coalesce(pk, '') <> ''").select("pk").distinct()
    return views.where(F.col("sk") == C.DEFAULT_SK).join(wanted, "pk", "left_semi")


def list_type(views: DataFrame, entity_type: str) -> DataFrame:
    return views.where(F.col("entity_type") == entity_type)


def list_pk(views: DataFrame, pk: str) -> DataFrame:
    return views.where(F.col("pk") == pk).orderBy("sk")


def each(views: DataFrame, f: Callable[[Row], bool | None]) -> None:
    """Calls ``f`` for each view, a partition at a time, until it returns False."""
    for row in views.toLocalIterator():
        if f(row) is False:
            return


def cursor(pk: Column, sk: Column) -> Column:
    """Opaque cursor of a view's key: base64url of a JSON map."""
    return C.b64url(F.encode(C.to_json(F.struct(pk.alias("pk"), sk.alias("sk"))), "utf-8"))


def uncursor(c: Column) -> Column:
    """Struct (pk, sk) of a cursor."""
    return F.from_json(C.unb64url(c).cast("string"), "pk string, sk string")


def page(views: DataFrame, limit: int, after: str | None = None) -> tuple[DataFrame, str]:
    """(views of a page in order of (pk, sk), cursor of the next or empty at the end). limit under 1: all the rest. A cursor that
    can't be read is a BadCursor. The driver gets two keys, the last of the page and the next one; the page itself is a range of keys."""
    rest = views
    if after:
        one = views.sparkSession.range(1).select(F.try_to_binary(
            F.translate(F.lit(after), "-_", "+/"), F.lit("base64")
        ).cast("string").alias("j"))
        key = one.select(F.when(C.is_json(F.col("j")), F.from_json("j", "pk string, sk string")).alias("k")).first().k
        if key is None or key.pk is None or key.sk is None:
            raise BadCursor(f"invalid cursor: {after}")
        rest = views.where((F.col("pk") > key.pk) | ((F.col("pk") == key.pk) & (F.col("sk") > key.sk)))
    rest = rest.orderBy("pk", "sk")
    if limit < 1:
        return rest, ""
    ends = rest.select("pk", "sk", cursor(F.col("pk"), F.col("sk")).alias("c")).limit(limit + 1).offset(limit - 1).collect()
    if len(ends) < 2:
        return rest.limit(limit), ""
    last = ends[0]
    return rest.where((F.col("pk") < last.pk) | ((F.col("pk") == last.pk) & (F.col("sk") <= last.sk))), last.c


def decode(views: DataFrame, schema: str) -> DataFrame:
    """Adds ``value`` and ``error`` (null, or a struct of pk and sk): JSON that is bad or doesn't fit the schema is an error."""
    parsed = F.from_json("payload", f"{schema}, __bad string", {"columnNameOfCorruptRecord": "__bad"})
    out = views.withColumn("__v", parsed)
    bad = F.col("payload").isNull() | ~C.is_json(F.col("payload")) | F.col("__v").isNull() | F.col("__v.__bad").isNotNull()
    return out.select(
        *views.columns, F.when(~bad, F.col("__v").dropFields("__bad")).alias("value"), F.when(bad, F.struct("pk", "sk")).alias("error")
    )


def decode_valid(views: DataFrame, schema: str) -> DataFrame:
    return decode(views, schema).where("error is null").drop("error")


def decode_errors(views: DataFrame, schema: str) -> DataFrame:
    return decode(views, schema).where("error is not null").select("error.pk", "error.sk")


def decode_strict(views: DataFrame, schema: str) -> DataFrame:
    """As ``decode_valid``; the first bad payload stops the query."""
    found = decode(views, schema)
    stop = F.raise_error(F.concat(F.lit("undecodable view "), F.col("pk"), F.lit("/"), F.col("sk")))
    return found.withColumn(
        "value", F.when(F.col("error").isNotNull(), stop.cast(found.schema["value"].dataType)).otherwise(F.col("value"))
    ).drop("error")


class ViewStore:
    """Typed access to the views of one type: ``schema`` of the payload, ``pk_of`` and ``id_of`` columns of a value."""

    def __init__(self, views: DataFrame, entity_type: str, schema: str, pk_of: Callable[[Column], Column] | None = None):
        self.views, self.entity_type, self.schema, self.pk_of = views, entity_type, schema, pk_of or (lambda id_: C.view_pk(F.lit(entity_type), id_))

    def get(self, pk: str) -> Row | None:
        return decode_strict(get(self.views, pk), self.schema).select("value.*").first()

    def put(self, values: DataFrame, entity_id: str) -> DataFrame:
        """The views with the values (columns of the schema) upserted; of equal keys any one wins."""
        rows = values.select(
            self.pk_of(F.col(entity_id)).alias("pk"), F.lit(C.DEFAULT_SK).alias("sk"), F.col(entity_id).alias("entity_id"),
            F.lit(self.entity_type).alias("entity_type"), C.to_json(F.struct(*values.columns)).alias("payload"),
            F.lit(None).cast("long").alias("ttl"), F.lit(1).alias("arrival")
        )
        self.views = upsert(self.views, rows)
        return self.views

    def list(self, on_error: Callable[[Row], None] | None = None) -> DataFrame:
        """Values that can be read; ``on_error`` gets the key of each of the others."""
        own = list_type(self.views, self.entity_type)
        if on_error:
            for row in decode_errors(own, self.schema).toLocalIterator():
                on_error(row)
        return decode_valid(own, self.schema).select("pk", "sk", "value.*")

    def page(self, limit: int, after: str | None = None) -> tuple[DataFrame, str]:
        rows, following = page(list_type(self.views, self.entity_type), limit, after)
        return decode_valid(rows, self.schema), following

    @staticmethod
    def empty(spark) -> DataFrame:
        return spark.createDataFrame([], VIEW)
