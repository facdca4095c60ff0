"""Catalogue, species books, identities and metadata rows."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echolake.functions import text

def metadata_pairs(texts: DataFrame, key: str = "id", column: str = "text") -> DataFrame:
    """Key/value rows of "Key: value" lines: trimmed, split at the first colon, blank and colon-free lines skipped."""
    lines = texts.select(key, F.posexplode(F.split(column, r"\r?\n")).alias("line_no", "line")).withColumn("line", F.trim("line"))
    return lines.where(F.col("line").contains(":")).select(
        key, "line_no", F.trim(F.regexp_extract("line", r"^([^:]*):", 1)).alias("key"), F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1)).alias("value")
    )


RECORDING_FIELDS = (
    "id gen sp ssp en grp rec cnt loc lat lon alt type sex stage method url file file-name lic q length time date uploaded rmk animal-seen "
    "playback-used temp regnr auto dvc mic smp"
).split()
PAGE_SCHEMA = "recordings array<struct<" + ", ".join(f"`{f}`:string" for f in RECORDING_FIELDS) + ", also:array<string>>>"


def parse_pages(pages: DataFrame, column: str = "body") -> tuple[DataFrame, DataFrame]:
    """(accepted recordings, quarantined rows) of result pages; a page whose recordings are no list is quarantined whole."""
    parsed = pages.withColumn("_p", F.from_json(column, PAGE_SCHEMA))
    bad_page = F.col("_p").isNull() | F.col("_p.recordings").isNull()
    rows = parsed.where(~bad_page).select(F.explode("_p.recordings").alias("r"))
    usable = F.coalesce(F.col("r.id").rlike(r"^\d+$") & F.col("r.id").try_cast("long").isNotNull() & (F.col("r.file") != ""), F.lit(False))
    rejected = rows.where(~usable).select(F.to_json("r").alias("body"), F.lit("bad_recording").alias("reason"))
    broken = parsed.where(bad_page).select(F.col(column).alias("body"), F.lit("no_recordings").alias("reason"))
    fields = [F.coalesce(F.col(f"r.`{f}`"), F.lit("")).alias(f) for f in RECORDING_FIELDS]
    return rows.where(usable).select(*fields, F.coalesce("r.also", F.array().cast("array<string>")).alias("also")), rejected.unionByName(broken)


# Hash keys kept in sidecar files.
HASH_KEYS = ("blake3", "sha256", "file_size", "spot_hash", "spot_hash_b3", "content_hash", "data_offset", "data_size")


def sidecar_hashes(sidecars: DataFrame, key: str, column: str = "body") -> DataFrame:
    """Hash fields under ``_app`` where that object exists, else from the top level."""
    nested = F.get_json_object(column, "$._app").isNotNull()
    fields = [F.when(nested, F.get_json_object(column, f"$._app.{k}")).otherwise(F.get_json_object(column, f"$.{k}")).alias(k) for k in HASH_KEYS]
    return sidecars.select(key, *fields)


def migrate_sidecars(sidecars: DataFrame, key: str, column: str = "body") -> DataFrame:
    """Move hash fields and ``retrieved`` under ``_app``; outcome is migrated, skipped (already so, or none) or error."""
    moved = [*HASH_KEYS, "retrieved"]
    whole = sidecars.withColumn("_m", F.from_json(column, "map<string,variant>"))
    keep = F.map_filter("_m", lambda k, v: ~k.isin(*moved, "_app"))
    app = F.map_filter("_m", lambda k, v: k.isin(moved))
    done = F.coalesce(F.get_json_object(column, "$._app").startswith("{"), F.lit(False))
    valid = F.col("_m").isNotNull() & F.try_parse_json(column).isNotNull()
    outcome = F.when(~valid, "error").when(done | (F.cardinality(app) == 0), "skipped").otherwise("migrated")
    inner = F.to_json(app)
    outer = F.to_json(keep)
    joined = F.when(outer == "{}", F.concat(F.lit('{"_app":'), inner, F.lit("}"))).otherwise(
        F.concat(F.expr("substr(_outer, 1, length(_outer) - 1)"), F.lit(',"_app":'), inner, F.lit("}"))
    )
    return whole.withColumn("_outer", outer).select(key, outcome.alias("outcome"), F.when(outcome == "migrated", joined).otherwise(F.col(column)).alias(column))


def migration_counts(migrated: DataFrame) -> DataFrame:
    return migrated.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def upsert(index: DataFrame, changes: DataFrame, key: str, deleted: DataFrame | None = None) -> DataFrame:
    """New rows replace old ones by id; deleted ids disappear. Running it twice changes nothing."""
    out = index.join(changes.select(key), key, "left_anti").unionByName(changes)
    return out.join(deleted.select(key), key, "left_anti") if deleted is not None else out


def _files_of(spark: SparkSession, path: str):
    """The file system of a folder and a maker of its paths."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at


def write_index(index: DataFrame, path: str, partition: str) -> None:
    """Replace the index in a folder: it is written beside it first, so it may be computed from the one it replaces.

    The old one is deleted only when the new one is in its place, and put back if that is refused. Readers may find no folder between the two
    renames; `commit_index` has no such moment.
    """
    fresh, old = f"{path}.{uuid.uuid4().hex}.new", f"{path}.{uuid.uuid4().hex}.old"
    index.write.partitionBy(partition).parquet(fresh)
    fs, at = _files_of(index.sparkSession, path)
    held = fs.exists(at(path))
    if held and not fs.rename(at(path), at(old)):
        fs.delete(at(fresh), True)
        raise OSError(f"cannot move the index {path}; it stays as it was")
    if not fs.rename(at(fresh), at(path)):
        if held and not fs.rename(at(old), at(path)):
            raise OSError(f"cannot move {fresh} to {path}; the old index is in {old}")
        fs.delete(at(fresh), True)
        raise OSError(f"cannot move {fresh} to {path}; the index stays as it was")
    if held:
        fs.delete(at(old), True)


class IndexConflict(RuntimeError):
    """Another writer committed the version that this one was to become."""


def _commits(spark: SparkSession, path: str) -> dict[int, str | None]:
    """The folder of each version; None for a commit that was cut off, which counts as taken but is never read."""
    fs, at = _files_of(spark, path)
    log = at(path, "_commits")
    if not fs.exists(log):
        return {}
    out = {}
    for status in fs.listStatus(log):
        if not (name := status.getPath().getName()).isdigit():
            continue
        stream = fs.open(status.getPath())
        try:
            line = bytes(stream.readNBytes(int(status.getLen()))).decode()
        finally:
            stream.close()
        out[int(name)] = line[:-1] if line.endswith("\n") else None
    return out


def index_version(spark: SparkSession, path: str) -> int:
    """The newest version of a versioned index; 0 where there is none."""
    return max((v for v, folder in _commits(spark, path).items() if folder), default=0)


def commit_index(index: DataFrame, path: str, partition: str, base: int | None = None) -> int:
    """Write an index as a new immutable version and return its number.

    `base` is the version that the rows were computed from (by default the newest one as the write begins). The data go to a folder of their own; a
    small commit file, created only if its number is free, makes them the newest version. So a killed writer leaves the versions before it as
    they were, and of two writers with one base the second gets IndexConflict and computes again. Needs a file system that creates
    files exclusively (HDFS, local ones).
    """
    spark = index.sparkSession
    fs, at = _files_of(spark, path)
    taken = _commits(spark, path)
    newest = max((v for v, folder in taken.items() if folder), default=0)
    base = newest if base is None else base
    if base != newest:
        raise IndexConflict(f"{path} is at version {newest}, not {base}")
    number, folder = max(taken, default=0) + 1, f"data-{uuid.uuid4().hex}"
    index.write.partitionBy(partition).parquet(f"{path}/{folder}")
    if any(v >= number for v in _commits(spark, path)) or not _created(fs, at(at(path, "_commits"), f"{number:010d}"), f"{folder}\n"):
        fs.delete(at(path, folder), True)
        raise IndexConflict(f"version {number} of {path} was committed by another writer")
    return number


def _created(fs, file, line: str) -> bool:
    """Create a file unless it exists."""
    try:
        stream = fs.create(file, False)
    except Py4JJavaError:
        if fs.exists(file):
            return False
        raise
    stream.write(bytearray(line.encode()))
    stream.close()
    return True


def read_index(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest version of an index, or a given one; it stays readable while later versions are committed."""
    folders = {v: folder for v, folder in _commits(spark, path).items() if folder}
    if not folders or version is not None and version not in folders:
        raise FileNotFoundError(f"no version {'' if version is None else version} of an index in {path}")
    return spark.read.parquet(f"{path}/{folders[max(folders) if version is None else version]}")


def drop_versions(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete the data of all but the newest versions; their commit files go first, so no reader finds a version without data."""
    fs, at = _files_of(spark, path)
    folders = {v: folder for v, folder in _commits(spark, path).items() if folder}
    for v in sorted(folders)[:-max(1, keep)]:
        fs.delete(at(at(path, "_commits"), f"{v:010d}"), False)
        fs.delete(at(path, folders[v]), True)


def refresh(local: DataFrame, catalogue: DataFrame, key: str, columns: Sequence[str], local_only: Sequence[str]) -> DataFrame:
    """Catalogue values win where present; local-only columns are kept."""
    fresh = catalogue.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return local.join(fresh, key, "full_outer").select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in columns], *local_only)


def species_list(catalogue: DataFrame) -> DataFrame:
    return catalogue.groupBy("gen", "sp").agg(F.min("en").alias("en"), F.count(F.lit(1)).alias("recordings"))


def needed_recordings(catalogue: DataFrame, held: DataFrame, quota: int) -> DataFrame:
    """Species still short of a quota, and by how much."""
    have = held.groupBy("gen", "sp").agg(F.count(F.lit(1)).alias("have"))
    wanted = catalogue.select("gen", "sp").distinct().join(have, ["gen", "sp"], "left").withColumn("have", F.coalesce("have", F.lit(0)))
    return wanted.withColumn("needed", F.lit(quota) - F.col("have")).where("needed > 0")


def best_candidates(catalogue: DataFrame, held: DataFrame, quota: int) -> DataFrame:
    """Best recordings per species by quality, then sample rate, that fill what is missing.

    The rank filter is pushed below the shuffle as a per-task group limit.
    """
    open_ = catalogue.join(held.select("id"), "id", "left_anti")
    w = Window.partitionBy("gen", "sp").orderBy(text.quality_rank("q"), F.col("smp").desc(), "id")
    top = open_.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= quota)
    return top.join(needed_recordings(catalogue, held, quota), ["gen", "sp"]).where(F.col("rank") <= F.col("needed"))


def match_tags(catalogue: DataFrame, grp: str | None = None, cnt: str | None = None, gen: str | None = None, sp: str | None = None,
               nr: str | None = None, anything: str | None = None) -> DataFrame:
    """Conjunction of tag filters; untagged text matches the species name."""
    out = catalogue
    for column, value in (("grp", grp), ("cnt", cnt), ("gen", gen), ("sp", sp), ("id", nr)):
        if value is not None:
            out = out.where(F.lower(column) == value.lower())
    if anything:
        out = out.where(F.lower(F.concat_ws(" ", "gen", "sp")).contains(anything.lower()) | F.lower("en").contains(anything.lower()))
    return out


def taxon_filter(catalogue: DataFrame, group: str, fragments: Sequence[str], group_column: str = "grp", name_column: str = "species") -> DataFrame:
    """The stated group decides; without one, a fragment of the name does."""
    hit = F.exists(F.array(*[F.lit(f) for f in fragments]), lambda f: F.lower(name_column).contains(f))
    return catalogue.where(F.coalesce(F.col(group_column) == group, hit, F.lit(False)))


# Genus fragments of the group 'bats'.
BAT_FRAGMENTS = (
    "myotis", "eptesicus", "pipistrellus", "nyctalus", "vespertilio", "plecotus", "rhinolophus", "hipposideros", "miniopterus", "barbastella",
    "tadarida", "molossus", "pteropus", "rousettus", "nyctimene", "austronomus", "chalinolobus", "vespadelus", "scotophilus", "lasiurus",
    "artibeus", "carollia", "desmodus", "glossophaga", "phyllostomus", "noctilio", "mormoops", "pteronotus", "emballonura", "taphozous",
    "saccolaimus", "coleura", "nycteris", "megaderma", "rhinopoma", "craseonycteris", "thyroptera", "furipterus", "natalus",
)


def country_region(rows: DataFrame, countries: DataFrame, column: str = "cnt") -> DataFrame:
    """Region of a country name from countries(country, region, approximate); unknown names stay null."""
    dim = countries.select(F.lower(F.trim("country")).alias("_c"), "region", "approximate")
    return rows.join(dim, F.lower(F.trim(column)) == F.col("_c"), "left").drop("_c")


def materialize_book(entries: DataFrame, species: DataFrame) -> DataFrame:
    """Book entries with species defaults; the position puts non-echolocating species last, otherwise in book order."""
    joined = entries.join(species, "species_id")
    return joined.select(
        "region", "species_id", F.coalesce("name_override", "name").alias("name"), F.coalesce("description_override", "description").alias("description"),
        "commonness", "echolocates", "ordinal",
    )


def selected_range(selection: DataFrame, book: DataFrame, recordings: DataFrame) -> DataFrame:
    """Combined frequency range of the species selected per recording, clamped to its Nyquist; none if above it."""
    spans = selection.join(book, "species_id").groupBy("recording_id").agg(F.min("freq_lo_hz").alias("lo"), F.max("freq_hi_hz").alias("hi")).where("lo < hi")
    nyquist = F.col("sample_rate") / 2
    rows = spans.join(recordings, "recording_id").where(F.col("lo") < nyquist)
    return rows.select("recording_id", F.col("lo").alias("lo_hz"), F.least("hi", nyquist).alias("hi_hz"), (F.col("hi") > nyquist).alias("clamped"))


def resolve_species(rows: DataFrame, entries: DataFrame, regions: DataFrame) -> DataFrame:
    """Book entry of rows(row_id, species, region): exact name or the binomial of a trinomial, in the row's own region
    where possible, else in the first region of the fixed order; entries(region, ordinal, species_id, scientific_name).
    """
    order = regions.select("region", "region_order")
    book = entries.join(order, "region").where(F.col("region") != "Global").groupBy(F.lower("scientific_name").alias("name"), "region").agg(
        F.min(F.struct("region_order", "ordinal", "species_id")).alias("e")
    )
    query = rows.withColumn("q", F.lower(F.trim("species")))
    words = F.split("q", r"\s+")
    names = F.when(F.size(words) > 2, F.array_distinct(F.array(F.col("q"), F.concat_ws(" ", F.get(words, F.lit(0)), F.get(words, F.lit(1)))))).otherwise(F.array("q"))
    hits = query.where("q <> ''").select("row_id", F.col("region").alias("own"), F.explode(names).alias("name")).join(book, "name")
    best = hits.groupBy("row_id").agg(
        F.min(F.struct(F.coalesce(F.col("region") != F.col("own"), F.lit(True)).alias("far"), F.col("e.region_order"), F.col("e.ordinal"), F.col("e.species_id").alias("species_id"), "region")).alias("b")
    )
    return rows.join(best, "row_id", "left").select(
        "row_id", F.col("b.species_id").alias("species_id"), F.when(F.col("b").isNotNull(), F.coalesce(rows["region"], F.col("b.region"))).otherwise(rows["region"]).alias("book_region")
    )


def resolve_books(rows: DataFrame, entries: DataFrame, regions: DataFrame, countries: DataFrame, favourite: str | None = None, fallback: str = "Global") -> DataFrame:
    """Book, highlighted species and label of the source for rows(row_id, species, country).

    The country's book wins, else the one that holds the species, else the favourite, else the fallback; regions(region, region_order, label),
    countries(country, region, approximate). A label names the book, and the country where that or the species decided; a country that its
    book covers only roughly is marked.
    """
    placed = country_region(rows, countries, "country").withColumnRenamed("region", "_own")
    found = resolve_species(placed.select("row_id", F.coalesce("species", F.lit("")).alias("species"), F.col("_own").alias("region")), entries, regions)
    known = F.col("book_region").isNotNull()
    region = F.coalesce("book_region", F.lit(favourite or fallback))
    chosen = placed.join(found, "row_id").select("row_id", "species_id", region.alias("region"), "country", "approximate", known.alias("_known"))
    named = chosen.join(regions.select("region", F.col("label").alias("_label")), "region", "left")
    suffix = F.when(F.col("approximate"), F.lit(", approx.")).otherwise(F.lit(""))
    short = F.coalesce("_label", "region")
    label = F.when(F.col("_known") & (F.col("country") != ""), F.concat(short, F.lit(" ("), "country", suffix, F.lit(")"))).otherwise(short)
    return named.select("row_id", "region", "species_id", label.alias("source_label"), (~F.col("_known") & F.lit(favourite is not None)).alias("from_favourite"))


def match_identities(left: DataFrame, right: DataFrame) -> DataFrame:
    """Best match of each left identity and its confidence: the strongest hash present on both sides decides.

    The right side is first reduced to one representative per key and presence pattern, so duplicate clusters never
    multiply. Columns: file_id, filename, file_size, data_size, full_hash, content_hash, spot_hash.
    """
    r = right.select(
        F.col("file_id").alias("rid"), F.col("filename").alias("r_name"), F.col("file_size").alias("r_size"), F.col("data_size").alias("r_data"),
        F.col("full_hash").alias("r_full"), F.col("content_hash").alias("r_content"), F.col("spot_hash").alias("r_spot"),
    )
    pattern = {"hf": F.col("r_full").isNotNull(), "hc": F.col("r_content").isNotNull(), "hs": F.col("r_spot").isNotNull()}
    for name, col in pattern.items():
        r = r.withColumn(name, col)
    no_full = F.col("full_hash").isNull() | ~F.col("hf")
    same_data = F.coalesce((F.col("data_size") == F.col("r_data")) & (F.col("data_size") > 0), F.lit(False))
    content_open = F.col("content_hash").isNull() | ~F.col("hc") | same_data
    no_spot = F.col("spot_hash").isNull() | ~F.col("hs")

    def reps(keys, extra):
        return r.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).groupBy(*keys, *extra).agg(F.min("rid").alias("rid"))

    def layer(level, keys, lkeys, extra, cond):
        on = [F.col(a) == F.col(b) for a, b in zip(lkeys, keys)]
        hits = left.join(reps(keys, extra), on).where(cond)
        return hits.groupBy("file_id").agg(F.min("rid").alias("rid")).select("file_id", F.lit(level).alias("level"), "rid")

    found = (
        layer(4, ["r_full"], ["full_hash"], [], F.lit(True))
        .unionByName(layer(3, ["r_content"], ["content_hash"], ["hf"], no_full))
        .unionByName(layer(2, ["r_spot"], ["spot_hash"], ["hf", "hc", "r_data"], no_full & content_open))
        .unionByName(layer(1, ["r_name", "r_size"], ["filename", "file_size"], ["hf", "hc", "hs", "r_data"], no_full & content_open & no_spot))
    )
    best = found.groupBy("file_id").agg(F.max(F.struct("level", (-F.col("rid")).alias("neg"))).alias("b"))
    label = F.element_at(F.array(*[F.lit(x) for x in ("none", "weak", "likely", "high", "certain")]), F.coalesce(F.col("b.level"), F.lit(0)) + 1)
    return left.select("file_id").join(best, "file_id", "left").select("file_id", label.alias("confidence"), (-F.col("b.neg")).alias("match_id"))


def duplicate_clusters(identities: DataFrame, column: str = "content_hash") -> DataFrame:
    return identities.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("copies"), F.min("file_id").alias("first_id")).where("copies > 1")


def merge_references(catalogue: DataFrame, sidecar: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Reference hashes per file: catalogue values override sidecar values field by field."""
    other = sidecar.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return catalogue.join(other, key, "full_outer").select(key, *[F.coalesce(c, f"_{c}").alias(c) for c in columns])


def verify_identities(files: DataFrame, references: DataFrame, key: str = "file_id", small_file: int = 24_000_000) -> DataFrame:
    """match, content_match, mismatch or pending: full hash for small files, spot hash for large ones, then content."""
    ref = references.select(key, *[F.col(c).alias(f"ref_{c}") for c in ("full_hash", "spot_hash", "content_hash")])
    joined = files.join(ref, key, "left")
    primary = F.when(F.col("file_size") < small_file, F.col("full_hash") == F.col("ref_full_hash")).otherwise(F.col("spot_hash") == F.col("ref_spot_hash"))
    outcome = (
        F.when(primary.isNull(), "pending").when(primary, "match")
        .when(F.coalesce(F.col("content_hash") == F.col("ref_content_hash"), F.lit(False)), "content_match").otherwise("mismatch")
    )
    return joined.select(key, outcome.alias("outcome"))


def daily_sample(pool: DataFrame, seed: int, count: int, key: str = "id") -> DataFrame:
    """The same ``count`` rows for the same seed, in id order."""
    picked = pool.withColumn("_h", F.xxhash64(F.lit(seed), F.col(key))).orderBy("_h", key).limit(count)
    return picked.drop("_h").orderBy(key)


def page(rows: DataFrame, order: Sequence[str], number: int, size: int) -> DataFrame:
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def file_rollup(files: DataFrame, dimensions: Sequence[str] = ("format", "sample_rate")) -> DataFrame:
    """Count, duration and size by the dimensions, with all subtotals."""
    return files.cube(*dimensions).agg(F.count(F.lit(1)).alias("files"), F.sum("duration_secs").alias("duration_secs"), F.sum("file_size").alias("file_size"))
