"""International host names in their ASCII form, by the encoder of the Java runtime, called as a Spark function."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOTS = "[。．｡]"  # full stops that count as dots
_OTHER = r"[^\x00-\x7F]"


def ascii_host(host: Column) -> Column:
    """A host name in lower case and ASCII; one that can't be encoded stays in its letters.

    Only hosts with other letters are looked at.  The encoding is that of RFC 3490, which writes "ß" as "ss".
    """
    dotted = F.regexp_replace(F.lower(host), DOTS, ".")
    encoded = F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), dotted)
    return F.when(host.rlike(_OTHER), F.coalesce(F.lower(encoded), dotted)).otherwise(F.lower(host))
