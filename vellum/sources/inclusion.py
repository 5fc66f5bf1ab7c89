"""Files that include each other: which are reached, in which order, and their text as one.

A file is taken once, where reading from the beginning meets it first. Its place is the list of the numbers of the mentions
that lead to it, by which the pieces of all texts are put in order. The names that an archive's files mention are one row, so
mentions are followed within it, without a join for each step; the texts are cut and joined at the end."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.sources.files import decoded, main_score
from vellum.sources.latex import without_comments
from vellum.storage import kept

# Commands that include a file, and how deep inclusion is followed.
INCLUDE = r"\\(?:input|include|subfile)\s*\{([^}]*)\}|\\input\s+([^\s{}\\]+)"
DEPTH = 15


def normal_path(path: str) -> str | None:
    """A path without empty, `.` and `..` parts; None where it leads out of its root."""
    parts: list[str] = []
    for part in path.split("/"):
        if part == "..":
            if not parts:
                return None
            parts.pop()
        elif part not in ("", "."):
            parts.append(part)
    return "/".join(parts)


def mentioned_names(text: Column) -> Column:
    """The names in the commands of a text that include a file, in order."""
    name = lambda m: F.trim(F.trim(F.concat(F.regexp_extract(m, INCLUDE, 1), F.regexp_extract(m, INCLUDE, 2))), F.lit('"'))
    return F.transform(F.regexp_extract_all(text, F.lit(INCLUDE), F.lit(0)), name)


def _included(paths: list[str], names: list[list[str]], main: str, depth: int) -> Iterator[tuple[str, list[int]]]:
    """The files of an archive that are reached from the main one, with their places.

    A name is looked for from the archive's root, then from the folder of the file that mentions it, with the ending .tex and without; a folder that holds everything counts as the root."""
    said = dict(zip(paths, names, strict=True))
    tops = {p.partition("/")[0] if "/" in p else None for p in paths}
    top = next(iter(tops)) or "" if len(tops) == 1 else ""
    seen, ahead = set(), [(main, [])]
    while ahead:
        path, place = ahead.pop()
        if path in seen:
            continue
        seen.add(path)
        yield path, place
        if len(place) > depth:
            continue
        folder, after = path.rpartition("/")[0], []
        for nth, name in enumerate(said[path]):
            tries = (normal_path(f"{base}/{x}") for base in (top, folder) for x in (name if name.endswith(".tex") else name + ".tex", name))
            file = next((t for t in tries if t in said), None)
            if file is not None:
                after.append((file, [*place, 2 * nth + 1]))
        ahead += reversed(after)


def inclusion_order(files: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(archive, main, order) of files (archive, path, names, score): the main file, the one of the best score, and (path, place) structs of it and all that it includes; archives without a scored file are left out.

    place: the numbers of the mentions that lead to a file, doubled and less one; empty for the main file."""
    order = F.udf(lambda paths, names, main: list(_included(paths, names, main, depth)), "array<struct<path:string,place:array<int>>>")
    best = F.max(F.when(F.col("score").isNotNull(), F.struct("score", "path")))["path"]
    whole = files.groupBy("archive").agg(best.alias("main"), F.collect_list(F.struct("path", "names")).alias("files")).filter("main is not null")
    return whole.select("archive", "main", order(F.col("files.path"), F.col("files.names"), "main").alias("order"))


def spliced(members: DataFrame, order: DataFrame) -> DataFrame:
    """(archive, path, text, n_files): the text of each archive's main file with the included ones in their places, a line of their own; commands that include nothing are left out.

    order (archive, main, order) comes to the members (archive, path, text) by archive alone, so that members dealt by archive are not shuffled."""
    own = F.filter("order", lambda o: o["path"] == F.col("path"))
    texts = members.join(order, "archive").select("archive", "main", "text", F.explode(own).alias("o")).select("archive", "main", "o.place", F.split("text", INCLUDE, -1).alias("pieces"))
    inner, last = F.size("place") > 0, F.size("pieces") - 1

    def cut(piece: Column, i: Column) -> Column:
        text = F.concat(F.when(inner & (i == 0), "\n").otherwise(""), piece, F.when(inner & (i == last), "\n").otherwise(""))
        return F.struct(F.concat("place", F.array((2 * i).cast("int"))).alias("at"), text.alias("piece"))

    parts = texts.select("archive", "main", F.transform("pieces", cut).alias("parts")).groupBy("archive").agg(F.first("main").alias("path"), F.array_sort(F.flatten(F.collect_list("parts"))).alias("parts"), F.count("*").alias("n_files"))
    return parts.select("archive", "path", F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("text"), "n_files")


def tex_members(members: DataFrame) -> DataFrame:
    """(archive, path, text) of unpacked members (archive, path, content): text files without comments."""
    return members.filter("content is not null").select("archive", "path", without_comments(decoded(F.col("content"))).alias("text"))


def expanded_papers(members: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(archive, path, text, n_files) of unpacked members: each archive's main LaTeX file with all that it includes."""
    texts = tex_members(members)
    named = texts.filter("path is not null").select("archive", "path", mentioned_names(F.col("text")).alias("names"), main_score(F.col("path"), F.col("text")).alias("score"))
    return spliced(texts, inclusion_order(named, depth))


def reached(starts: DataFrame, edges: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(start, node, steps): every node within `depth` steps of a start, with the least number; starts (start, node), edges (node, to).

    Each round joins the nodes that were new in the round before; a node is never looked at twice for a start."""
    edges = kept(edges.select("node", "to").distinct(), "edges")
    seen = kept(starts.select("start", "node", F.lit(0).alias("steps")).distinct(), "reached")
    ahead = seen
    for step in range(1, depth + 1):
        ahead = ahead.join(edges, "node").select("start", F.col("to").alias("node")).distinct().join(seen, ["start", "node"], "left_anti").withColumn("steps", F.lit(step))
        ahead = kept(ahead.select("start", "node", "steps"), "reached")
        if ahead.isEmpty():
            break
        seen = seen.unionByName(ahead)
    return seen
