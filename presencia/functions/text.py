"""Text columns: sample ids, peptides, proteins and their cuts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_all(c: Column) -> Column:
    """Trim every kind of Unicode white space. The pattern, which goes through
    every letter, is left to values whose ends are not visible ASCII."""
    bare = F.substring(c, 1, 1).between("!", "~") & F.substring(c, -1, 1).between("!", "~")
    return F.when(bare, c).otherwise(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def sample_id(c: Column) -> Column:
    """Trimmed, without a trailing ``.raw`` in any case."""
    return F.regexp_replace(strip_all(c), r"(?i)\.raw$", "")


def peptide(c: Column, policy: str = "il-equivalent") -> Column:
    """Trimmed, upper case; ``il-equivalent`` merges I and L as J."""
    plain = F.upper(strip_all(c))
    return F.translate(plain, "IL", "JJ") if policy == "il-equivalent" else plain


def number(c: Column) -> Column:
    """A double, null where the text is none."""
    return c.try_cast("double")


def short_header(c: Column) -> Column:
    return F.substring_index(c, " ", 1)


def sanitised_protein(c: Column) -> Column:
    """Without white space and the stop marks at the end."""
    return F.regexp_replace(F.regexp_replace(c, r"\s+", ""), r"\*+$", "")


#: Cut after K or R, not before P.
TRYPTIC = "(?<=[KR])(?!P)"


def fragments(protein: Column, rule: str = TRYPTIC, missed: int = 0) -> Column:
    """Every run of 1 to ``missed + 1`` consecutive fragments, as an array."""
    parts = F.filter(F.split(protein, rule), lambda x: x != "")
    if missed == 0:
        return parts

    def runs(p: Column) -> Column:
        each = F.transform(p, lambda _, i: F.transform(F.slice(F.array(*[F.lit(n) for n in range(1, missed + 2)]), F.lit(1), F.size(p) - i), lambda n: F.array_join(F.slice(p, i + 1, n), "")))
        return F.flatten(each)

    # bound to a name, so that the protein is cut once and not once per run
    return F.element_at(F.transform(F.array(parts), runs), 1)


def is_included(c: Column) -> Column:
    """Whether a flag includes its sample: anything but the known words."""
    words = ("0", "false", "no", "n", "off")
    return F.coalesce(~F.lower(strip_all(c)).isin(*words), F.lit(True))
