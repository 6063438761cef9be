"""Paths that no plan may remove."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from boscage.functions import paths

# Fixed values.
EXACT = (
    "/", "/Applications", "/Library", "/System", "/Users", "/Volumes", "/bin", "/cores", "/etc", "/opt", "/private", "/private/etc", "/private/tmp", "/private/var",
    "/sbin", "/tmp", "/usr", "/usr/local", "/var", "/opt/homebrew", "/Users/Shared",
)
PREFIXES = ("/System/", "/bin/", "/sbin/", "/Library/", "/private/etc/", "/private/var/db/")
HOME_FOLDERS = (
    "", "/Applications", "/Desktop", "/Documents", "/Downloads", "/Library", "/Movies", "/Music", "/Pictures", "/Public", "/.Trash", "/.ssh", "/.gnupg",
    "/Pictures/Photos Library.photoslibrary", "/Library/Application Support", "/Library/Caches", "/Library/CloudStorage", "/Library/Containers", "/Library/Developer",
    "/Library/Group Containers", "/Library/Keychains", "/Library/Logs", "/Library/Mail", "/Library/Messages", "/Library/Mobile Documents",
    "/Library/Mobile Documents/com~apple~CloudDocs", "/Library/Preferences",
)
VAULTS = ("/.ssh/", "/.gnupg/", "/Library/Keychains/", "/Library/Mail/", "/Library/Messages/")


def refusal(path: Column, home: str) -> Column:
    """Why a path must not be removed; null if it may be."""
    cloud = "/Library/CloudStorage/"
    rest = F.regexp_extract(path, "^/Users/[^/]*(/.*)?$", 1)
    relative = F.when(paths.is_same_or_inside(path, F.lit(home)), F.substring(path, F.lit(len(home) + 1), F.length(path))).when(path.startswith("/Users/"), rest)
    starts = lambda c, ps: F.concat(*[F.when(c.startswith(p), "x").otherwise("") for p in ps]) != ""
    return (
        F.when(~path.startswith("/") | path.contains("/../") | path.endswith("/..") | path.contains("//"), "not an absolute, normalized path")
        .when(path.isin(*EXACT), "system location")
        .when(path.startswith("/usr/") & ~path.startswith("/usr/local/"), "system location")
        .when(starts(path, PREFIXES), "system location")
        .when(relative == "", "home directory")
        .when(relative.isin(*HOME_FOLDERS), "standard home folder")
        .when(F.coalesce(starts(relative, VAULTS), F.lit(False)), "credentials or mail")
        .when(relative.startswith(cloud) & ~F.substring(relative, F.lit(len(cloud) + 1), F.length(relative)).contains("/"), "cloud storage folder")
        .when(paths.parent(path) == "/Volumes", "volume root")
    )
