"""Data model: entity handles, entity types, tags, and the ``Mesh`` of relations.

A mesh is a set of relations held as lazy DataFrames. Nothing is mutable: every
operator that changes a mesh returns a new one.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Entity types by number, their topological dimension and corner count (0: variable).
ETYPES = ("VERTEX", "EDGE", "TRI", "QUAD", "POLYGON", "TET", "PYRAMID", "PRISM", "KNIFE", "HEX", "POLYHEDRON", "ENTITYSET")
DIMENSIONS = (0, 1, 2, 2, 2, 3, 3, 3, 3, 3, 3, 4)
CORNERS = (1, 2, 3, 4, 0, 4, 5, 6, 7, 8, 0, 0)

#: Handles are ``type << 56 | id``: the sign bit stays clear for all twelve types, so handles sort by type, then id.
SHIFT = 56
ID_MASK = (1 << SHIFT) - 1

VERTEX, EDGE, TRI, QUAD, POLYGON, TET, PYRAMID, PRISM, KNIFE, HEX, POLYHEDRON, ENTITYSET = range(12)
TRACK_OWNER, SET_LIKE, ORDERED = 1, 2, 4


class MeshError(ValueError):
    """An operator's failure, with one of the model's codes."""

    # The error codes of the model.
    CODES = ("SUCCESS", "INDEX_OUT_OF_RANGE", "TYPE_OUT_OF_RANGE", "MEMORY_ALLOCATION_FAILED", "ENTITY_NOT_FOUND", "MULTIPLE_ENTITIES_FOUND", "TAG_NOT_FOUND", "FILE_DOES_NOT_EXIST", "FILE_WRITE_ERROR", "NOT_IMPLEMENTED", "ALREADY_ALLOCATED", "VARIABLE_DATA_LENGTH", "INVALID_SIZE", "UNSUPPORTED_OPERATION", "UNHANDLED_OPTION", "STRUCTURED_MESH", "FAILURE")

    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: {message}" if message else code)
        self.code = code


def handle(etype: int | Column, ident: Column) -> Column:
    """Handle of the entity ``ident`` (from 1) of a type."""
    base = F.lit(etype << SHIFT) if isinstance(etype, int) else F.shiftleft(etype.cast("long"), SHIFT)
    return base.bitwiseOR(ident.cast("long"))


def etype_of(h: Column) -> Column:
    return F.shiftright(h, SHIFT).cast("int")


def id_of(h: Column) -> Column:
    return h.bitwiseAND(F.lit(ID_MASK))


def dimension_of(h: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, DIMENSIONS)), etype_of(h) + 1)


def dimension_of_type(etype: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, DIMENSIONS)), etype.cast("int") + 1)


def type_name(etype: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ETYPES)), etype.cast("int") + 1)


def type_from_name(name: str) -> int:
    """Type number of a name, in any case."""
    try:
        return ETYPES.index(name.upper())
    except ValueError:
        raise MeshError("TYPE_OUT_OF_RANGE", name) from None


def of_type(h: Column, etype: int) -> Column:
    """Handles of one type, as an interval of handles, so that a scan can skip files by their bounds."""
    return (h >= (etype << SHIFT)) & (h < ((etype + 1) << SHIFT))


def of_dimension(h: Column, dim: int) -> Column:
    """Handles of one dimension, as an interval. Dimensions above 3 mean sets."""
    first = DIMENSIONS.index(min(dim, 4))
    last = len(DIMENSIONS) - 1 - DIMENSIONS[::-1].index(min(dim, 4))
    return (h >= (first << SHIFT)) & (h < ((last + 1) << SHIFT))


@dataclass(frozen=True)
class Tag:
    """A named, typed column over entities: ``values(entity, value)``.

    ``length`` 0 means variable. ``default`` None means none.
    """

    name: str
    dtype: str
    values: DataFrame
    default: Any = None
    length: int = 1
    storage: str = "sparse"


#: Elements that a task holds; with tasks of a fixed number, a task's memory would grow with the mesh.
SLICE = 250_000


def slices(spark, rows: int | None) -> int:
    """How many tasks share so many rows; 0 for a few rows, or if their number isn't known: as Spark's settings have it."""
    return 0 if not rows or rows <= SLICE else max(spark.sparkContext.defaultParallelism, -(-rows // SLICE))


def dealt(df: DataFrame, rows: int | None, *columns: str) -> DataFrame:
    """``df`` by columns to so many tasks as ``rows`` ask for; frames dealt by the same columns of a join or a group move no more."""
    n = slices(df.sparkSession, rows)
    return df.repartition(n, *columns) if n else df


@dataclass(frozen=True)
class Mesh:
    """Relations of a mesh.

    ``vertices(handle, x, y, z)``, ``elements(handle, etype, conn)``,
    ``sets(handle, flags)``, ``members(set, pos, entity)``,
    ``links(parent, child, pos)``, ``explicit(from, to)`` and tags by name.
    """

    vertices: DataFrame
    elements: DataFrame
    sets: DataFrame | None = None
    members: DataFrame | None = None
    links: DataFrame | None = None
    explicit: DataFrame | None = None
    tags: dict[str, Tag] = field(default_factory=dict)
    dimension: int = 3
    #: About how many elements there are, if that was known when the mesh was made; large relations are dealt by it.
    rows: int | None = None

    @property
    def spark(self):
        return self.vertices.sparkSession

    def tag(self, name: str) -> Tag:
        if name not in self.tags:
            raise MeshError("TAG_NOT_FOUND", name)
        return self.tags[name]

    def with_(self, **changes: Any) -> Mesh:
        return replace(self, **changes)

    def handles(self) -> DataFrame:
        """All entities, sets included, as one column."""
        out = self.vertices.select("handle").unionByName(self.elements.select("handle"))
        return out.unionByName(self.sets.select("handle")) if self.sets is not None else out

    def dealt(self, df: DataFrame, *columns: str) -> DataFrame:
        return dealt(df, self.rows, *columns)

    def incidence(self) -> DataFrame:
        """``(elem, pos, vertex)``, from each element's connectivity."""
        return self.elements.select(F.col("handle").alias("elem"), F.posexplode("conn").alias("pos", "vertex"))


def mesh_from_arrays(spark, coords: list[tuple[float, float, float]], cells: list[tuple[str, list[int]]]) -> Mesh:
    """A small mesh from coordinates and ``(type name, 0-based vertex numbers)``; ids count from 1 by type."""
    vertices = [(i + 1, *map(float, p)) for i, p in enumerate(coords)]
    count = [0] * 12
    elements = []
    for name, conn in cells:
        t = type_from_name(name)
        count[t] += 1
        elements.append(((t << SHIFT) | count[t], t, [v + 1 for v in conn]))
    return Mesh(spark.createDataFrame(vertices, "handle long, x double, y double, z double"), spark.createDataFrame(elements, "handle long, etype int, conn array<long>"))
