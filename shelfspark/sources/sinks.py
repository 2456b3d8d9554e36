"""Files that players read: game lists as XML, playlists as text."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import names as N

# Tags of the list and the metadata columns that they hold.
LIST_TAGS = {"desc": "description", "releasedate": "release_date", "developer": "developer", "publisher": "publisher", "genre": "genre", "players": "players", "rating": "rating"}


def gamelist_rows(items: DataFrame, metadata: DataFrame, covers: DataFrame, artwork: str = "./media/{stem}{ext}") -> DataFrame:
    """system_id and the tags of each item's list entry; empty values are null and so no tags.

    items: id, system_id, filename, title, canonical_name; metadata: rom_id and values; covers: id, rom_id, local_path, is_preferred.
    The image is named by the preferred cover with a file, else by the one with the least id.
    """
    order = F.struct(-F.col("is_preferred").cast("int"), "id")
    best = covers.where("local_path IS NOT NULL").groupBy("rom_id").agg(F.min_by("local_path", order).alias("local_path"))
    values = metadata.select("rom_id", *(F.nullif(F.col(c).cast("string"), F.lit("")).alias(tag) for tag, c in LIST_TAGS.items()))
    out = items.join(values, F.col("id") == values.rom_id, "left").drop("rom_id").join(best, F.col("id") == best.rom_id, "left")
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    suffix = F.regexp_extract("local_path", r"[^/](\.[^./]+)$", 1)
    image = F.replace(F.replace(F.lit(artwork), F.lit("{stem}"), N.stem(F.col("filename"))), F.lit("{ext}"), suffix)
    return out.select("system_id", F.concat(F.lit("./"), "filename").alias("path"), F.coalesce(blank("canonical_name"), blank("title"), N.stem(F.col("filename"))).alias("name"), F.when(suffix != "", image).alias("image"), *LIST_TAGS)


def write_gamelists(rows: DataFrame, path: str) -> None:
    """Lists under path/system_id=.../; a large system has several, each a whole list of its part."""
    rows.write.format("xml").option("rootTag", "gameList").option("rowTag", "game").partitionBy("system_id").mode("overwrite").save(path)


def read_gamelists(spark, path: str) -> DataFrame:
    fields = ", ".join(f"{c} string" for c in ["path", "name", "image", *LIST_TAGS])
    return spark.read.format("xml").option("rowTag", "game").option("basePath", path).schema(f"{fields}, system_id string").load(path)


def write_texts(rows: DataFrame, root: str) -> DataFrame:
    """Writes each row's content (text or bytes) to root/rel_path and returns rel_path, n_bytes of what was written.

    root is on a mount that every executor has. A file appears under its name only when it is whole, and a task that
    runs again writes the same bytes again. Rows whose rel_path leaves the root are refused (n_bytes null).
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = uuid.uuid4().hex, set()
        for batch in batches:
            sizes = []
            for rel_path, content, ok in zip(*(batch.column(c) for c in ("rel_path", "content", "ok")), strict=True):  # one content at a time as an object
                if not ok.as_py() or not content.is_valid:
                    sizes.append(None)
                    continue
                target = os.path.join(root, rel_path.as_py())
                folder = os.path.dirname(target)
                if folder not in made:
                    os.makedirs(folder, exist_ok=True)
                    made.add(folder)
                part = f"{target}.{task}.part"
                data = content.as_py()
                data = data.encode() if isinstance(data, str) else data
                with open(part, "wb") as f:
                    f.write(data)
                os.replace(part, target)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column("rel_path"), pa.array(sizes, pa.int64())], ["rel_path", "n_bytes"])

    checked = rows.select("rel_path", "content", F.coalesce(N.valid_relative_path(F.col("rel_path")), F.lit(False)).alias("ok"))
    return checked.mapInArrow(write, "rel_path string, n_bytes long")


def write_books(entries: DataFrame, root: str, head: str) -> None:
    """A file for each book (columns book, entry): head, then its entries. A thousand files share a folder, named so that readers take the folders as one table; root is there even without any."""
    os.makedirs(root, exist_ok=True)
    place = F.concat(F.lit("shelf="), F.expr("book div 1000"), F.lit("/"), "book", F.lit(".yaml"))
    texts = entries.groupBy("book").agg(F.concat(F.lit(head), F.array_join(F.collect_list("entry"), "")).alias("content"))
    write_texts(texts.select(place.alias("rel_path"), "content"), root).write.format("noop").mode("overwrite").save()


def playlist_files(playlists: DataFrame, folder: str) -> DataFrame:
    """rel_path and content of playlists (columns folder, base, content)."""
    return playlists.select(F.concat(folder, F.lit("/"), N.safe_filename(F.col("base")), F.lit(".m3u")).alias("rel_path"), F.concat("content", F.lit("\n")).alias("content"))
