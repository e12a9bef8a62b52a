"""Canonical keys for site, chromosome and sample identifiers, as JVM-side column expressions.

A site id names a chromosome and a position ("chr01:5", "1_5", " 1-5"); all spellings map to ``1_5``. An id that names
none keeps its trimmed upper-case text as a key of its own. A null or blank id has a null key. The SQL twins below
give the same keys in any engine with RE2-style ``regexp_replace``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SITE_PATTERN = r"^(?:CHR)?0*([0-9]{1,2}|X|Y|MT?)[_:\-]0*([0-9]{1,18})$"
CHROM_PATTERN = r"^(?:CHR)?0*([0-9]{1,2}|X|Y|MT?)$"
NAMED = r"^([0-9]{1,2}|X|Y|MT?)_[0-9]+$"


def _clean(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), r"^[\s ]+|[\s ]+$", "")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def site_key(c: Column | str) -> Column:
    s = F.regexp_replace(_clean(_col(c)), SITE_PATTERN, "$1_$2")
    return F.when(F.length(s) > 0, s)


def chrom_key(c: Column | str) -> Column:
    s = F.regexp_replace(_clean(_col(c)), CHROM_PATTERN, "$1")
    return F.when(F.length(s) > 0, s)


def site_chrom(key: Column | str, chrom: Column | str | None = None) -> Column:
    """The chromosome the site key names; else the normalised chromosome column, if one is given."""
    k = _col(key)
    named = F.when(k.rlike(NAMED), F.substring_index(k, "_", 1))
    return named if chrom is None else F.coalesce(named, chrom_key(chrom))


def sample_key(c: Column | str) -> Column:
    """Letters and digits, case aside; an id of other signs only keeps its trimmed text."""
    s = _clean(_col(c))
    bare = F.regexp_replace(s, r"[^\p{L}\p{N}]", "")
    return F.when(F.length(bare) > 0, bare).when(F.length(s) > 0, s)


def sql_site(c: str) -> str:
    s = rf"regexp_replace(upper(trim({c})), '{SITE_PATTERN}', '\1_\2')"
    return f"nullif({s}, '')"


def sql_chrom(c: str) -> str:
    return rf"nullif(regexp_replace(upper(trim({c})), '{CHROM_PATTERN}', '\1'), '')"


def sql_site_chrom(site: str, chrom: str | None = None) -> str:
    named = f"CASE WHEN regexp_matches({site}, '{NAMED}') THEN split_part({site}, '_', 1) END"
    return named if chrom is None else f"coalesce({named}, {sql_chrom(chrom)})"


def sql_sample(c: str) -> str:
    s = f"upper(trim({c}))"
    return rf"coalesce(nullif(regexp_replace({s}, '[^\p{{L}}\p{{N}}]', '', 'g'), ''), nullif({s}, ''))"
