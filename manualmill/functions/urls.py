"""URL parts, slugs and names as Columns; malformed URLs give NULL or empty parts, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# First labels of a host that name no product.
GENERIC_LABELS = ("www", "docs", "manual", "manuals", "help", "support")
# Archive suffixes, image suffixes.
ARCHIVE_SUFFIXES = (".zip", ".tar.gz", ".tgz", ".tar.bz2", ".tbz2", ".epub")
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def netloc(url: Column) -> Column:
    """Authority in lower case, port included; empty without one."""
    return F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1))


def host(url: Column) -> Column:
    """Host in lower case without user and port."""
    return F.regexp_replace(F.regexp_replace(netloc(url), r"^.*@", ""), r":\d*$", "")


def path(url: Column) -> Column:
    rest = F.regexp_replace(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*", "")
    return F.regexp_replace(rest, r"[?#].*$", "")


def segments(url: Column) -> Column:
    """Non-empty path segments."""
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def last_segment(url: Column) -> Column:
    return F.substring_index(F.regexp_replace(path(url), "/+$", ""), "/", -1)


def without_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def names_a_file(url: Column) -> Column:
    return path(url).rlike(r"\.[A-Za-z][A-Za-z0-9]{1,5}$")


def base_dir(url: Column, any_dot: bool = False) -> Column:
    """URL of the folder, without a trailing slash: a last segment that names a file (any_dot: that has a dot) is dropped."""
    bare = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), "/+$", "")
    drops = path(bare).rlike(r"/[^/]*\.[^/]*$") if any_dot else names_a_file(bare)
    return F.when(drops, F.regexp_replace(bare, r"/[^/]*$", "")).otherwise(bare)


def slugify(text: Column) -> Column:
    """Lower-case ASCII kebab form; empty if no ASCII letter or digit is left.  Accents must be folded before (see fold_udf)."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def slug_from_host(h: Column) -> Column:
    labels = F.split(F.regexp_replace(F.lower(h), r":\d*$", ""), r"\.")
    kept = F.when((F.size(labels) > 1) & F.get(labels, F.lit(0)).isin(*GENERIC_LABELS), F.slice(labels, 2, 100)).otherwise(labels)
    first = F.regexp_replace(F.get(kept, F.lit(0)), "_", "-")
    return F.when(first.isNull() | (first == ""), "docs").otherwise(first)


def slug_from_gitbook(url: Column) -> Column:
    labels = F.split(netloc(url), r"\.")
    second = (~netloc(url).endswith("gitbook.io")) & (F.size(labels) > 1) & (F.get(labels, F.lit(0)) == "docs")
    return F.when(second, F.get(labels, F.lit(1))).otherwise(F.get(labels, F.lit(0)))


def slug_from_archive(url: Column) -> Column:
    stem = F.regexp_replace(last_segment(url), r"(?i)(\.zip|\.tar\.gz|\.tgz|\.tar\.bz2|\.tbz2|\.epub)$", "")
    return F.when(slugify(stem) == "", "docs").otherwise(slugify(stem))


def slug_from_help_center(url: Column) -> Column:
    label = F.get(F.split(F.regexp_replace(netloc(url), r"^(www\.)?(support\.)?", ""), r"\."), F.lit(0))
    own = F.when(slugify(label) == "", "help").otherwise(slugify(label))
    number = F.regexp_extract(path(url), r"/articles/(\d+)", 1)
    name = F.regexp_extract(path(url), r"/articles/\d+-([^/]+)", 1)
    return F.when(number != "", slugify(F.concat_ws("-", own, F.when(name != "", name).otherwise(number)))).otherwise(own)


def slug_from_topic(url: Column, marker: str) -> Column:
    """The segment after a marker segment, such as guide or books."""
    return F.regexp_extract(path(url), f"/{marker}/([^/]+)", 1)


def locale(url: Column) -> Column:
    found = F.regexp_extract(path(url), r"/hc/([a-z]{2}-[a-z]{2})", 1)
    return F.when(found == "", "en-us").otherwise(found)


def repository(url: Column) -> Column:
    """struct(owner, repo, branch, subdir) of a code host URL; branch NULL if it names none."""
    s = segments(url)
    tree = (F.size(s) >= 4) & (F.get(s, F.lit(2)) == "tree")
    return F.struct(
        F.get(s, F.lit(0)).alias("owner"),
        F.get(s, F.lit(1)).alias("repo"),
        F.when(tree, F.get(s, F.lit(3))).alias("branch"),
        F.when(tree, F.array_join(F.slice(s, 5, 1000), "/")).otherwise("").alias("subdir"),
    )


def natural_key(text: Column) -> Column:
    """Array that sorts embedded numbers by value: runs of digits padded, other text in lower case."""
    parts = F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(F.lower(p)))


def image_name(url: Column) -> Column:
    """Local name of a remote image: clean lower-case stem and the image suffix, .jpg for .jpeg, none for other suffixes."""
    base = F.substring_index(path(url), "/", -1)
    stem = F.regexp_replace(F.regexp_replace(base, r"\.[A-Za-z0-9]+$", ""), "[^A-Za-z0-9._-]+", "-")
    stem = F.lower(F.regexp_replace(stem, "^-+|-+$", ""))
    suffix = F.lower(F.regexp_extract(base, r"[^.](\.[^./]+)$", 1))
    suffix = F.when(suffix == ".jpeg", ".jpg").when(suffix.isin(*IMAGE_SUFFIXES), suffix).otherwise("")
    return F.concat(F.when(stem == "", "image").otherwise(stem), suffix)


def human_size(n: Column) -> Column:
    d = n.cast("double")  # ties are rounded to even
    return (
        F.when(n < 1024, F.format_string("%.0f B", d))
        .when(n < 1024**2, F.format_string("%.1f KB", F.bround(d / 1024, 1)))
        .when(n < 1024**3, F.format_string("%.1f MB", F.bround(d / 1024**2, 1)))
        .otherwise(F.format_string("%.1f GB", F.bround(d / 1024**3, 1)))
    )
