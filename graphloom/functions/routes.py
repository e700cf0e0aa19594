"""Routes that a file's place in the tree declares, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCRIPT = r"[cm]?[jt]sx?"


def segment_route(rest: Column) -> Column:
    """A route of path segments: ``(group)`` is dropped, ``[x]`` is a parameter and
    ``[...x]`` takes the rest."""
    kept = F.filter(F.split(rest, "/"), lambda s: (s != "") & ~s.rlike(r"^\(.*\)$"))
    shown = F.transform(kept, lambda s: F.regexp_replace(F.regexp_replace(s, r"^\[\.\.\.(.+)\]$", r"*$1"), r"^\[(.+)\]$", r":$1"))
    return F.concat(F.lit("/"), F.array_join(shown, "/"))


def dotted_route(rest: Column) -> Column:
    """A route of a dotted file name: ``$x`` is a parameter, ``_x`` is no segment."""
    parts = F.filter(F.split(F.translate(rest, ".", "/"), "/"), lambda s: ~s.startswith("_"))
    return F.concat(F.lit("/"), F.array_join(F.transform(parts, lambda s: F.regexp_replace(s, r"^\$", ":")), "/"))


def file_route(path: Column) -> Column:
    """A struct (kind, route) of a routed file, kind ``http`` or ``page``; null for
    every other file. The first layout that fits decides."""
    path = F.translate(path, "\\", "/")

    def part(pattern: str, group: int = 1) -> Column:
        return F.regexp_extract(path, pattern, group)

    def routed(kind: Column, route: Column) -> Column:
        return F.struct(kind.alias("kind"), route.alias("route"))

    app = rf"(?:^|/)app/(.*?)/?(route|page)\.{_SCRIPT}$"
    api = rf"(?:^|/)pages/api/(.*?)\.{_SCRIPT}$"
    kit = r"(?:^|/)src/routes/(.*?)/?\+(server|page)\.(?:[cm]?[jt]s|svelte)$"
    dotted = rf"(?:^|/)app/routes/(.*?)\.{_SCRIPT}$"
    screen = rf"(?:^|/)app/(.*?)/?(?:index|_layout)\.{_SCRIPT}$"
    page = r"(?:^|/)(?:src/)?pages/(.*?)\.(?:astro|vue)$"
    http, shown = F.lit("http"), F.lit("page")
    below = segment_route(part(api))
    return (
        F.when(path.rlike(app), routed(F.when(part(app, 2) == "route", http).otherwise(shown), segment_route(part(app))))
        .when(path.rlike(api), routed(http, F.concat(F.lit("/api"), below)))
        .when(path.rlike(kit), routed(F.when(part(kit, 2) == "server", http).otherwise(shown), segment_route(part(kit))))
        .when(path.rlike(dotted), routed(http, dotted_route(part(dotted))))
        .when(path.rlike(screen), routed(shown, segment_route(part(screen))))
        .when(path.rlike(page), routed(shown, segment_route(F.regexp_replace(part(page), "(?:^|/)index$", ""))))
    )
