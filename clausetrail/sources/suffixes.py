"""Public suffixes: complete lists from a file, by default the one that comes with the JVM.

Every Java runtime from 9 on carries the public suffix list beside its security files, so a session has a complete list
without a download.  A newer or an own list is a parameter: a path, in the published text format, in the setting
``spark.clausetrail.publicSuffixes``.  Where there is neither, a short list is made by rule from fixed names.
"""

from __future__ import annotations

import os
import shutil
import zipfile
from functools import lru_cache
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import SparkSession

SETTING = "spark.clausetrail.publicSuffixes"

# Generic top-level names, country codes that register below themselves and below the
# second-level names, and names that sites share.  They serve where no list is found.
GENERIC_SUFFIXES = ["com", "net", "org", "io", "eu", "dev", "app", "me", "info", "biz", "network", "edu", "gov"]
COUNTRY_SUFFIXES = [
    "ae", "ar", "at", "au", "be", "bg", "br", "ca", "ch", "cl", "cn", "co", "cy", "cz", "de", "dk", "ee", "eg", "es", "fi",
    "fr", "gr", "hk", "hr", "hu", "id", "ie", "il", "in", "is", "it", "jp", "ke", "kr", "li", "lt", "lu", "lv", "mt", "mx",
    "my", "ng", "nl", "no", "nz", "pe", "ph", "pk", "pl", "pt", "ro", "rs", "ru", "sa", "se", "sg", "si", "sk", "th", "tr",
    "tw", "ua", "uk", "us", "vn", "za",
]
SECOND_LEVELS = ["ac", "co", "com", "edu", "go", "gob", "gov", "govt", "mil", "ne", "net", "nom", "or", "org", "re", "sch"]
# Hosts of the sample tables below this name are sites of their own.
SAMPLE_SUFFIXES = ["pages.example"]

Rule = tuple[str, str]


def parsed(text: str) -> list[Rule]:
    """(suffix, kind) of lines in the published format: '*.x' wildcards, '!y.x' exceptions, '//' comments."""
    rules = []
    for line in text.splitlines():
        # In the runtime's file a leading control character tells the section.
        name = line.strip().lstrip("\x00\x01\x02").split(" ")[0].lower().strip(".")
        if not name or name.startswith("//"):
            continue
        kind = "exception" if name[0] == "!" else "wildcard" if name.startswith("*.") else "exact"
        rules.append((_ascii(name.removeprefix("!").removeprefix("*.")), kind))
    return rules


def _ascii(name: str) -> str:
    """The name as hosts have it; labels of other alphabets in their xn-- form."""
    return ".".join(x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in name.split("."))


def runtime_home() -> Path | None:
    """The folder of the Java runtime: of the running session, else the one that would run it."""
    context = SparkContext._active_spark_context
    if context is not None and context._jvm is not None:
        return Path(context._jvm.java.lang.System.getProperty("java.home"))
    if os.environ.get("JAVA_HOME"):
        return Path(os.environ["JAVA_HOME"])
    java = shutil.which("java")
    return Path(java).resolve().parent.parent if java else None


def _from_runtime() -> list[Rule]:
    home = runtime_home()
    file = home / "lib/security/public_suffix_list.dat" if home else None
    if file is None or not file.exists():
        return []
    with zipfile.ZipFile(file) as entries:
        return [rule for name in entries.namelist() for rule in parsed(entries.read(name).decode())]


def short_list() -> list[Rule]:
    names = GENERIC_SUFFIXES + COUNTRY_SUFFIXES + [f"{second}.{country}" for country in COUNTRY_SUFFIXES for second in SECOND_LEVELS]
    return [(name, "exact") for name in names]


@lru_cache(maxsize=1)
def default_rules() -> list[Rule]:
    """The runtime's list, else the short one, with the sample names."""
    return sorted({*(_from_runtime() or short_list()), *((name, "exact") for name in SAMPLE_SUFFIXES)})


def configured_path(spark: SparkSession) -> str | None:
    return spark.conf.get(SETTING, None)
