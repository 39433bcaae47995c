"""Column expressions for entity codes and labels."""

from pyspark.sql import Column, functions as F

#: Labels that mean no label.
NO_LABEL = ("", "NAN", "NONE", "UNK", "SKIP", "UNKNOWN")


def entity_code(c: Column) -> Column:
    """Trimmed upper case, without what follows the first full stop, digits padded to 6 on the left; '' for none."""
    code = F.upper(F.trim(F.coalesce(c.cast("string"), F.lit(""))))
    code = F.split_part(code, F.lit("."), F.lit(1))
    code = F.when(code.isin("", "NAN"), F.lit("")).otherwise(code)
    return F.when((code != "") & (F.length(code) < 6), F.lpad(code, 6, "0")).otherwise(code)


def label(c: Column) -> Column:
    """The trimmed label, null if it says that there is none."""
    t = F.trim(c.cast("string"))
    return F.when(~F.upper(t).isin(*NO_LABEL), t)


def label_after_colon(description: Column, name: Column) -> Column:
    """What follows the first ASCII colon of a description, or else its first full width colon, '' too; without either the
    name without a level prefix."""
    text, plain = F.coalesce(description, F.lit("")), F.trim(F.coalesce(name, F.lit("")))
    after = lambda colon: F.trim(F.regexp_extract(text, f"^[^{colon}]*{colon}((?s).*)$", 1))
    out = F.when(F.contains(text, F.lit(":")), after(":")).when(F.contains(text, F.lit("：")), after("："))
    return out.otherwise(F.trim(F.regexp_replace(plain, r"^SW[123]", "")))


def label_level(cls: Column, id_: Column, name: Column) -> Column:
    """The level 1, 2 or 3 of a label row as text SW1 to SW3: its class, else _SWn_ in the id, else a prefix of the name, else ''."""
    of = lambda c, p: F.regexp_extract(F.upper(F.coalesce(c, F.lit(""))), p, 1)
    found = [of(cls, r"^(SW[123])$"), of(id_, r"_(SW[123])_"), of(name, r"^(SW[123])")]
    return F.coalesce(*(F.when(f != "", f) for f in found), F.lit(""))
