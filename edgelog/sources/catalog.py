"""The mirror catalog and the sanity-check targets as dimension tables.

Both are small configuration tables (tens of rows, fixed by the deployment),
so joining them by broadcast is bounded by construction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Production mirror catalog, in configuration order.
# (name, interval minutes, provider, retry, stage1_profile)
PROD_MIRRORS = [
    ("alpine", 1440, "rsync", None, None),
    ("apache", 1440, "rsync", None, None),
    ("archlinux", 720, "rsync", None, None),
    ("archlinuxcn", 720, "rsync", None, None),
    ("archlinuxarm", 720, "rsync", None, None),
    ("elrepo", 720, "rsync", None, None),
    ("epel", 720, "rsync", None, None),
    ("centos", 720, "rsync", None, None),
    ("centos-altarch", 1440, "rsync", None, None),
    ("centos-stream", 1440, "rsync", None, None),
    ("centos-vault", 1440, "rsync", None, None),
    ("debian", 720, "rsync", 100, None),
    ("debian-security", 720, "rsync", None, None),
    ("docker-ce", 1440, "rsync", None, None),
    ("fedora", 1440, "rsync", None, None),
    ("gitlab-ce", 1440, "rsync", None, None),
    ("gitlab-runner", 1440, "rsync", None, None),
    ("grafana", 1440, "rsync", None, None),
    ("jenkins", 1440, "rsync", None, None),
    ("kubernetes", 1440, "rsync", None, None),
    ("linuxmint", 1440, "two-stage-rsync", None, "debian"),
    ("mariadb", 720, "rsync", None, None),
    ("mongodb", 1440, "rsync", None, None),
    ("mysql", 1440, "rsync", None, None),
    ("nodejs-release", 1440, "rsync", None, None),
    ("opensuse", 1440, "rsync", None, None),
    ("pypi", 5, "command", None, None),
    ("raspbian", 1440, "rsync", None, None),
    ("raspberrypi", 1440, "rsync", None, None),
    ("rubygems", 60, "command", None, None),
    ("ubuntu", 720, "two-stage-rsync", None, "debian"),
    ("ubuntu-cdimage", 1440, "rsync", None, None),
    ("ubuntu-releases", 1440, "rsync", None, None),
    ("bioconductor", 1440, "rsync", None, None),
    ("CPAN", 720, "rsync", None, None),
    ("CRAN", 1440, "rsync", None, None),
    ("CTAN", 1440, "rsync", None, None),
    ("ceph", 1440, "rsync", None, None),
    ("chef", 1440, "rsync", None, None),
    ("clojars", 1440, "rsync", None, None),
    ("dart-pub", 1440, "rsync", None, None),
    ("elasticstack", 1440, "rsync", None, None),
    ("erlang-solutions", 1440, "rsync", None, None),
    ("flutter", 1440, "rsync", None, None),
    ("hackage", 120, "rsync", None, None),
    ("influxdata", 1440, "rsync", None, None),
    ("julia", 60, "rsync", None, None),
    ("julia-releases", 1440, "rsync", None, None),
    ("libreoffice", 1440, "rsync", None, None),
    ("openresty", 1440, "rsync", None, None),
    ("rustup", 1440, "rsync", None, None),
    ("sagemath", 1440, "rsync", None, None),
    ("saltstack", 1440, "rsync", None, None),
    ("zabbix", 1440, "rsync", None, None),
]

# Non-production mirror catalog.
OTHER_MIRRORS = [
    ("elrepo", 720, "rsync", 10, None),
    ("pypi", 5, "command", None, None),
]

# The multi-line start pattern and time format of the mirrors that have one.
LOG_FORMATS = {
    "pypi": (r"^\d{4}-\d{2}-\d{2}\s\d{2}:\d{2}:\d{2},\d{3}", "%Y-%m-%d %H:%M:%S"),
}

# Sanity-check targets (name, repo, images, commands) per stage; <domain> is the site's own.
PROD_SANITY_TARGETS = [
    ("Ubuntu", "ubuntu", ["ubuntu:18.04", "ubuntu:20.04"], [
        'sed -E -i "s/(archive.ubuntu.com|security.ubuntu.com)/<domain>/" /etc/apt/sources.list',
        "apt update"]),
    ("Debian", "debian", ["debian:stable", "debian:testing"], [
        'sed -E -i "s/(deb.debian.org|security.debian.org)/<domain>/" /etc/apt/sources.list',
        "apt update"]),
    ("CentOS", "centos", ["centos:7"], [
        r"sed -i 's/mirrorlist/#mirrorlist/;s/#baseurl=http:\/\/mirror.centos.org/baseurl=https:\/\/<domain>/' /etc/yum.repos.d/CentOS-*.repo",
        "yum makecache"]),
    ("Fedora", "fedora", ["fedora:34", "fedora:35", "fedora:36"], [
        r"sed -i 's/metalink/#metalink/;s/#baseurl=http:\/\/download.example\/pub\/fedora\/linux/baseurl=https:\/\/<domain>\/fedora/' /etc/yum.repos.d/fedora{,-updates,-modular,-updates-modular}.repo",
        "yum makecache"]),
    ("Alpine", "alpine", ["alpine:3.9", "alpine:3.11", "alpine:3.12"], [
        "sed -i 's/dl-cdn.alpinelinux.org/<domain>/g' /etc/apk/repositories",
        "apk update"]),
    ("ELRepo", "elrepo", ["centos:7"], [
        r"sed -i 's/mirrorlist/#mirrorlist/;s/#baseurl=http:\/\/mirror.centos.org/baseurl=https:\/\/<domain>/' /etc/yum.repos.d/CentOS-*.repo",
        "rpm --import https://www.elrepo.org/RPM-GPG-KEY-elrepo.org",
        "yum install -y https://www.elrepo.org/elrepo-release-7.el7.elrepo.noarch.rpm",
        r"sed -i 's/mirrorlist/#mirrorlist/;s/elrepo.org\/linux/<domain>\/elrepo/' /etc/yum.repos.d/elrepo.repo",
        "yum makecache"]),
]
OTHER_SANITY_TARGETS = [
    ("ELRepo", "elrepo", ["centos:7"], [
        "rpm --import https://www.elrepo.org/RPM-GPG-KEY-elrepo.org",
        "yum install -y https://www.elrepo.org/elrepo-release-7.el7.elrepo.noarch.rpm",
        r"sed -i 's/mirrorlist/#mirrorlist/;s/elrepo.org\/linux/<domain>\/elrepo/' /etc/yum.repos.d/elrepo.repo",
        "yum makecache"]),
]

MIRROR_SCHEMA = T.StructType([
    T.StructField("stage", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("interval", T.IntegerType()),
    T.StructField("provider", T.StringType()),
    T.StructField("retry", T.IntegerType()),
    T.StructField("stage1_profile", T.StringType()),
    T.StructField("log_start_pattern", T.StringType()),
    T.StructField("time_format", T.StringType()),
])


def _mirror_rows():
    for stage, rows in (("prod", PROD_MIRRORS), ("other", OTHER_MIRRORS)):
        for name, interval, provider, retry, stage1 in rows:
            pat, fmt = LOG_FORMATS.get(name, (None, None))
            yield (stage, name, interval, provider, retry, stage1, pat, fmt)


def mirror_catalog(spark: SparkSession, stage: str = "prod") -> DataFrame:
    """One row per configured mirror of ``stage`` (missing fields NULL)."""
    df = spark.createDataFrame(list(_mirror_rows()), MIRROR_SCHEMA)
    return df.where(df.stage == ("prod" if stage == "prod" else "other"))


def sanity_targets(spark: SparkSession, stage: str = "prod", domain: str = "mirror.example.org") -> DataFrame:
    """(name, repo, images[], commands[]) per stage; the commands name ``domain``, the site's own."""
    rows = [(name, repo, images, [c.replace("<domain>", domain) for c in commands])
            for name, repo, images, commands in (PROD_SANITY_TARGETS if stage == "prod" else OTHER_SANITY_TARGETS)]
    return spark.createDataFrame(rows, "name string, repo string, images array<string>, commands array<string>")


def mirror_values_sql(stage: str = "prod") -> str:
    """The catalog as an inline VALUES list (used by the SQL oracles)."""
    rows = PROD_MIRRORS if stage == "prod" else OTHER_MIRRORS

    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, int):
            return str(v)
        return "'" + v.replace("'", "''") + "'"
    body = ",\n".join("(" + ", ".join(lit(x) for x in r) + ")" for r in rows)
    return f"(VALUES {body}) AS m(name, \"interval\", provider, retry, stage1_profile)"
