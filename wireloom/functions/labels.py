"""Display labels, edge signatures and element styles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Edge signatures are below this.
SIGNATURE_MODULUS = 100_000_000


def display_label(label: Column, index: Column) -> Column:
    return F.concat_ws(", ", label, index.cast("string"))


def list_text(ids: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(ids, lambda x: x.cast("string")), ", "), F.lit("]"))


def signature_text(index: Column, sources: Column, targets: Column) -> Column:
    return F.concat(index.cast("string"), F.lit(":"), list_text(sources), F.lit("->"), list_text(targets))


def bytes_modulo(text: Column, modulus: int = SIGNATURE_MODULUS) -> Column:
    """ASCII text as a big-endian number, modulo."""
    places = F.sequence(F.lit(1), F.length(text))
    step = lambda n, i: (n * 256 + F.ascii(F.substr(text, i, F.lit(1)))) % modulus
    return F.when(F.length(text) > 0, F.aggregate(places, F.lit(0).cast("long"), step)).otherwise(F.lit(0).cast("long"))


def edge_signature(index: Column, sources: Column, targets: Column) -> Column:
    """Depends on the numbering: it names an edge of one graph, it doesn't compare graphs."""
    return bytes_modulo(signature_text(index, sources, targets))


def node_text(label: Column, index: Column) -> Column:
    return F.concat(label, F.lit(";"), index.cast("string"))


def edge_text(label: Column, index: Column, signature: Column) -> Column:
    return F.concat(label, F.lit(","), index.cast("string"), F.lit("\\n\\n"), signature.cast("string"))


def style(index: Column, highlighted: list[int], colour: Column | None, scheme: str) -> Column:
    """Red where highlighted, else the scheme's colour by number, else black."""
    plain = F.lit("black") if colour is None else F.when(colour.isNotNull(), F.concat(F.lit(f"/{scheme}/"), (colour + 1).cast("string"))).otherwise("black")
    return F.when(index.isin(highlighted), F.lit("red")).otherwise(plain) if highlighted else plain
