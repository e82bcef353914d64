"""Caps for small holes: simple loops of boundary edges get a center and a fan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import Scratch, stored
from .dense import dense_ids
from .mesh import Mesh, face_edges, renormaled


def boundary_edges(faces: DataFrame) -> DataFrame:
    """Directed edges (u, v) of which no other face has a part."""
    e = face_edges(faces)
    return e.groupBy("lo", "hi").agg(F.count("*").alias("n"), F.first("u").alias("u"), F.first("v").alias("v")).where("n = 1").select("u", "v")


def _jumps(steps: DataFrame, rounds: int, scratch: Scratch) -> list[DataFrame]:
    """``steps``: vid, to (the vertex ahead).  Tables of 1, 2, 4, ... steps ahead: vid, to, n (steps taken) and low (the
    least vertex from vid to there); vertices without a row end a walk."""
    out = [scratch.stored(steps.select("vid", "to", F.lit(1).alias("n"), F.least("vid", "to").alias("low")), "jumps")]
    for _ in range(rounds):
        here = out[-1]
        ahead = here.select(F.col("vid").alias("to"), F.col("to").alias("far"), F.col("n").alias("more"), F.col("low").alias("lower"))
        twice = here.join(ahead, "to", "left").select("vid", F.coalesce("far", "to").alias("to"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), F.least("low", "lower").alias("low"))
        out.append(scratch.stored(twice, "jumps"))
    return out


def _single_loops(edges: DataFrame, max_edges: int, name: str, scratch: Scratch) -> DataFrame:
    """Loops of ``edges`` that touch others at their first vertex only: loop, second, pos, vid, stored as ``name``."""
    rounds = max(2, (max(1, max_edges) - 1).bit_length())
    with Scratch(edges.sparkSession) as own:
        ways = edges.groupBy("u").agg(F.count("*").alias("ways"), F.min("v").alias("to"))
        steps = own.stored(ways.where("ways = 1").select(F.col("u").alias("vid"), "to"), "steps")
        # least vertices of loops without such a touch: their walk goes on as far as pointers reach
        far = _jumps(steps, rounds, own)[-1]
        least = far.where("low = vid").join(steps.select(F.col("vid").alias("to")), "to", "left_semi").select("vid")
        least = own.stored(least, "least")
        jumps = _jumps(steps.join(least, "vid", "left_anti"), rounds, own)
        ends = ways.where("ways > 1").select(F.col("u").alias("vid")).unionByName(least)
        first = edges.join(ends, F.col("u") == F.col("vid"), "left_semi").select(F.col("u").alias("loop"), F.col("v").alias("second"))
        back = jumps[-1].select(F.col("vid").alias("second"), "to", "n")
        first = first.join(back, "second", "left").where(F.coalesce("to", "second") == F.col("loop")).withColumn("size", F.coalesce("n", F.lit(0)) + 1)
        loops = own.stored(first.where(F.col("size").between(3, max_edges)).select("loop", "second", "size"), "loops")
        members = loops.select("loop", "second", "size", F.lit(1).alias("pos"), F.col("second").alias("vid"))
        for jump in jumps[:-1]:  # the places that are reached, and those as far ahead again
            ahead = members.join(jump.select("vid", "to", "n"), "vid").where("pos + n < size")
            members = own.stored(members.unionByName(ahead.select("loop", "second", "size", (F.col("pos") + F.col("n")).alias("pos"), F.col("to").alias("vid"))), "members")
        start = loops.select("loop", "second", F.lit(0).alias("pos"), F.col("loop").alias("vid"))
        out = start.unionByName(members.select("loop", "second", "pos", "vid"))
        return scratch.stored(out.select("loop", "second", F.col("pos").cast("bigint").alias("pos"), "vid"), name)


def hole_loops(faces: DataFrame, max_edges: int) -> DataFrame:
    """loop (its first vertex), second, pos and vid of each closed loop of 3 to ``max_edges`` boundary edges.

    A vertex with one boundary edge out of it points to the next one; where two holes touch at a vertex, that one has
    more and is where their loops begin and end.  Other loops begin at their least vertex.  Pointers are
    doubled, so the rounds grow with the logarithm of ``max_edges``; no walk is made edge by edge.  Loops that
    touch several others are found when those are taken away."""
    spark = faces.sparkSession
    with Scratch(spark) as scratch:
        edges = scratch.stored(boundary_edges(faces), "boundary")
        found: list[DataFrame] = []
        while True:
            touching = not edges.groupBy("u").count().where("count > 1").isEmpty()
            new = _single_loops(edges, max_edges, "loops", scratch)
            found.append(new)
            if not touching or new.isEmpty():
                break
            ahead = F.coalesce(F.lead("vid").over(Window.partitionBy("loop", "second").orderBy("pos")), F.col("loop"))
            taken = new.select(F.col("vid").alias("u"), ahead.alias("v"))
            edges = scratch.stored(edges.join(taken, ["u", "v"], "left_anti"), "boundary")
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return stored(out, "hole-loops")


def fill_holes(mesh: Mesh, max_edges: int) -> tuple[Mesh, int]:
    """The mesh with a fan over each small hole, and their number; centers have mean position and color."""
    if max_edges < 3 or mesh.faces.isEmpty():
        return mesh, 0
    loops = stored(hole_loops(mesh.faces, max_edges), "loops")
    sizes = loops.agg(F.count_distinct("loop", "second")).first()[0]
    if not sizes:
        return mesh, 0
    top = mesh.vertices.agg(F.max("vid")).first()[0] + 1
    last = mesh.faces.agg(F.max("fid")).first()[0] + 1
    at = loops.join(mesh.vertices, "vid")
    centers = at.groupBy("loop", "second").agg(*[F.avg(c).cast("float").cast("double").alias(c) for c in ("x", "y", "z", "cr", "cg", "cb")])
    # loops are numbered in the order of their first edges: one row per loop
    centers = stored(centers.withColumn("vid", F.row_number().over(Window.orderBy("loop", "second")) - 1 + F.lit(top)), "centers")
    vertices = mesh.vertices.unionByName(centers.select("vid", "x", "y", "z", *[F.lit(0.0).alias(f"n{c}") for c in "xyz"], "cr", "cg", "cb"))
    ring = loops.withColumn("n", F.count("*").over(Window.partitionBy("loop", "second")))
    ahead = loops.select("loop", "second", F.col("pos").alias("next"), F.col("vid").alias("a"))
    fan = ring.withColumn("next", (F.col("pos") + 1) % F.col("n")).join(ahead, ["loop", "second", "next"]).join(centers.select("loop", "second", F.col("vid").alias("c")), ["loop", "second"])
    fan = fan.select(((F.col("c") - top) * (max_edges + 1) + F.col("pos")).alias("o"), "a", F.col("vid").alias("b"), "c")
    fan = dense_ids(fan, "o", "f").select((F.col("f") + last).alias("fid"), "a", "b", "c")
    faces = stored(mesh.faces.unionByName(fan), "capped-faces")
    return Mesh(stored(renormaled(vertices, faces), "capped"), faces), sizes
