"""Names of studies and participants in tags and file paths, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that stand for a missing key or path.
NULL_WORDS = ("", "nan", "none", "null", "n/a", "na", "<na>", "nat", "unknown", "not_specified", "-")
_RELEASE = r"(?:@v[0-9]+(?:[.][0-9]+)*|[_ -]v[0-9]+(?:[.][0-9]+)*)$"
#: Naming habits of paths (lower case, forward slashes), each with the participant's number as its only group.
PARTICIPANT_PATTERNS = (
    r"(?:^|/)sub-0*([0-9]+)(?:[/_.]|$)",
    r"/s0*([0-9]+)/s0*[0-9]+r[0-9]+[.]",
    r"(?:^|/)subject[_ -]?0*([0-9]+)(?:[/_.]|$)",
    r"/flat/0*([0-9]+)_[0-9]+_",
    r"__vp0*([0-9]+)[.]",
    r"/p0*([0-9]+)[a-z]_",
    r"(?:^|/)participant[ _-]?0*([0-9]+)(?:[/_.]|$)",
)


def folded(text: Column) -> Column:
    """Lower-case letters and digits only, without a release: one form for all spellings of a tag."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(text)), _RELEASE, ""), "[^a-z0-9]", "")


def path_text(path: Column) -> Column:
    """Lower-case ``path`` with forward slashes and without percent escapes; null-like ones are null."""
    p = F.lower(F.translate(path, "\\", "/"))
    p = F.coalesce(F.try_url_decode(p), p)
    return F.when(~F.trim(p).isin(*NULL_WORDS), p)


def study_key(path: Column, tag: Column, studies: list[str]) -> Column:
    """Folded name of the study that a folder of ``path`` names, in any spelling; else the one of ``tag``.

    Null where neither names a study of ``studies``, the folded list of the known ones.
    """
    known = F.array(*[F.lit(x) for x in sorted(studies)]).cast("array<string>")
    return F.coalesce(
        F.get(F.array_intersect(F.transform(F.split(path_text(path), "/"), folded), known), F.lit(0)),
        F.get(F.array_intersect(F.array(folded(tag)), known), F.lit(0)),
    )


def participant_key(path: Column, tag: Column, studies: list[str]) -> Column:
    """``study#number`` of a recording's participant, null where the path tells none.

    The number is the one that the first fitting habit of ``PARTICIPANT_PATTERNS`` gives,
    without leading zeros.
    """
    p, study = path_text(path), study_key(path, tag, studies)
    number = F.coalesce(*[F.nullif(F.regexp_extract(p, r, 1), F.lit("")) for r in PARTICIPANT_PATTERNS])
    return F.concat(study, F.lit("#"), number)


def known_studies(studies: DataFrame, limit: int = 10_000) -> list[str]:
    """Folded names of a small table of studies; more than ``limit`` raise ValueError."""
    names = studies.select(folded(F.col("domain_tag")).alias("s")).where("s <> ''").distinct().limit(limit + 1).collect()
    if len(names) > limit:
        raise ValueError("studies is meant to be a small dimension")
    return [r[0] for r in names]
