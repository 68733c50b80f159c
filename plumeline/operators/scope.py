"""Which documents are analysed: by a tag in their frontmatter and by folder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import Settings, folder_list

IGNORE_TAG = "plumeline-ignorer"
TAG_KEYS = ("tags", "tag")
SEPARATOR = r"[\s,]+"


def _items(frontmatter: Column, key: str) -> Column:
    """The texts of a property, each cut at white space and commas; frontmatter: map<string, array<string>>."""
    parts = F.flatten(F.transform(F.get(F.array(frontmatter[key]), F.lit(0)), lambda x: F.split(F.coalesce(x, F.lit("")), SEPARATOR)))
    return F.filter(F.coalesce(parts, F.array().cast("array<string>")), lambda x: x != "")


def _plain(tag: Column) -> Column:
    return F.lower(F.regexp_replace(tag, "^#", ""))


def tags_of(frontmatter: Column, key: str) -> Column:
    return F.filter(F.transform(_items(frontmatter, key), _plain), lambda x: x != "")


def has_ignore_tag(frontmatter: Column, tag: str = IGNORE_TAG) -> Column:
    hit = [F.array_contains(tags_of(frontmatter, k), tag) for k in TAG_KEYS]
    return F.coalesce(hit[0] | hit[1], F.lit(False))


def add_ignore_tag(frontmatter: Column, tag: str = IGNORE_TAG) -> Column:
    """The frontmatter with the tag under "tags"; as it is if it has the tag."""
    empty = F.create_map().cast("map<string, array<string>>")
    base = F.coalesce(frontmatter, empty)
    rest = F.map_filter(base, lambda k, v: k != "tags")
    new = F.map_concat(rest, F.create_map(F.lit("tags"), F.concat(_items(base, "tags"), F.array(F.lit(tag)))))
    return F.when(has_ignore_tag(base, tag), base).otherwise(new)


def remove_ignore_tag(frontmatter: Column, tag: str = IGNORE_TAG) -> Column:
    """The frontmatter without the tag; a property that held nothing else goes."""
    holds = lambda v: F.exists(v, lambda x: F.array_contains(F.transform(F.split(F.coalesce(x, F.lit("")), SEPARATOR), _plain), tag))
    stay = lambda v: F.filter(F.filter(F.flatten(F.transform(v, lambda x: F.split(F.coalesce(x, F.lit("")), SEPARATOR))), lambda x: x != ""), lambda x: _plain(x) != tag)
    named = lambda k: k.isin(*TAG_KEYS)
    trimmed = F.transform_values(frontmatter, lambda k, v: F.when(named(k) & F.coalesce(holds(v), F.lit(False)), stay(v)).otherwise(v))
    untouched = lambda k: ~F.coalesce(holds(F.element_at(frontmatter, k)), F.lit(False))
    return F.map_filter(trimmed, lambda k, v: ~named(k) | untouched(k) | (F.size(v) > 0))


def exclusion_of(path: Column, frontmatter: Column | None, settings: Settings, tag: str = IGNORE_TAG) -> Column:
    """Why a document is left out: "tag", "folder" or null.  The tag comes first, excluded folders before included ones.

    Paths are compared in lower case; give them in composed form (sources.documents does)."""
    name = F.lower(path)
    under = lambda folders: F.greatest(*[name.startswith(f"{f}/") for f in folders], F.lit(False)) if folders else F.lit(False)
    included, excluded = folder_list(settings.included_folders), folder_list(settings.excluded_folders)
    out = under(excluded) if not included else under(excluded) | ~under(included)
    tagged = has_ignore_tag(frontmatter, tag) if frontmatter is not None else F.lit(False)
    return F.when(tagged, "tag").when(out, "folder")
