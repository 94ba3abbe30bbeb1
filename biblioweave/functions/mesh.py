"""MeSH class expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUALIFIER = "struct<term:string,meshId:string,majorTopic:boolean>"
MESH_CLASS = (
    "struct<descriptor:struct<term:string,meshId:string,majorTopic:boolean>,"
    f"qualifiers:array<{QUALIFIER}>,"
    "chemical:struct<term:string,meshId:string,registry:string>>"
)


def mesh_struct(
    term: Column, mesh_id: Column, major: Column, qualifiers: Column | None = None
) -> Column:
    """A descriptor class with its qualifiers."""
    return F.struct(
        F.struct(term.alias("term"), mesh_id.alias("meshId"), major.alias("majorTopic")).alias(
            "descriptor"
        ),
        (F.lit(None) if qualifiers is None else qualifiers)
        .cast(f"array<{QUALIFIER}>")
        .alias("qualifiers"),
        F.lit(None).cast("struct<term:string,meshId:string,registry:string>").alias("chemical"),
    )


def mesh_chemical(term: Column, mesh_id: Column, registry: Column) -> Column:
    """A chemical substance class."""
    return F.struct(
        F.lit(None).cast("struct<term:string,meshId:string,majorTopic:boolean>").alias("descriptor"),
        F.lit(None).cast(f"array<{QUALIFIER}>").alias("qualifiers"),
        F.struct(
            term.alias("term"), mesh_id.alias("meshId"), registry.alias("registry")
        ).alias("chemical"),
    )


def _flag(c: Column) -> Column:
    return F.when(c, "true").otherwise("false")


def mesh_record(mesh: Column) -> Column:
    """MeSH class in the shape used inside work records."""
    descriptor = F.when(
        mesh["descriptor"].isNotNull(),
        F.struct(
            mesh["descriptor"]["term"].alias("term"),
            mesh["descriptor"]["meshId"].alias("meshId"),
            _flag(mesh["descriptor"]["majorTopic"]).alias("majorTopic"),
        ),
    )
    qualifiers = F.when(
        F.size(mesh["qualifiers"]) > 0,
        F.transform(
            mesh["qualifiers"],
            lambda q: F.struct(
                F.struct(
                    q["term"].alias("term"),
                    q["meshId"].alias("meshId"),
                    _flag(q["majorTopic"]).alias("majorTopic"),
                ).alias("qualifier")
            ),
        ),
    )
    chemical = F.when(
        mesh["chemical"].isNotNull(),
        F.struct(
            mesh["chemical"]["term"].alias("term"),
            mesh["chemical"]["meshId"].alias("meshId"),
            mesh["chemical"]["registry"].alias("chemicalRegistryNumber"),
        ),
    )
    return F.struct(
        descriptor.alias("descriptor"),
        qualifiers.alias("qualifiers"),
        chemical.alias("chemical"),
    )


def mesh_to_json(mesh: Column) -> Column:
    """JSON text of one MeSH class."""
    return F.to_json(mesh_record(mesh))


def has_major_topic(mesh: Column) -> Column:
    """True when the descriptor or one of its qualifiers is a major topic."""
    return F.coalesce(mesh["descriptor"]["majorTopic"], F.lit(False)) | F.coalesce(
        F.exists(mesh["qualifiers"], lambda q: q["majorTopic"]), F.lit(False)
    )
