"""Command line: a filter from standard input to standard output, or files rewritten in place. Exit codes: 0 done, 1 a document failed, 2 usage or configuration."""

from __future__ import annotations

import argparse
import json
import os
import sys
import tempfile

CONFIG_NAME = ".glyphmillrc.json"
#: Bytes that a character of the length cap may take.
BYTES_PER_UNIT = 3


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="glyphmill", description=__doc__)
    p.add_argument("files", nargs="*", help="files; none or - reads standard input")
    p.add_argument("--html", action="store_true", default=None)
    p.add_argument("--entities", action="store_true", default=None)
    p.add_argument("--input", dest="format", help="text, html, markdown, json, xml, yaml, toml or frontmatter")
    p.add_argument("--hanging", choices=("style", "class", "both"))
    p.add_argument("--max-input", type=int)
    p.add_argument("--max-ms", type=int, help="time budget of a document in milliseconds; 0 for none")
    p.add_argument("--rule", action="append", default=[], metavar="NAME=on|off")
    p.add_argument("--render", action="append", default=[], metavar="NAME=VALUE")
    p.add_argument("--set", action="append", default=[], metavar="PATH=JSON", help="any setting by its dotted path, such as rules.dash.em=false or fields=[\"title\"]")
    p.add_argument("--config", help=f"configuration file; else the nearest {CONFIG_NAME} upwards")
    p.add_argument("-w", "--write", action="store_true", help="rewrite the files in place")
    p.add_argument("-o", "--output", help="write to this file")
    return p


def nearest(folder: str) -> str | None:
    while True:
        path = os.path.join(folder, CONFIG_NAME)
        if os.path.isfile(path):
            return path
        up = os.path.dirname(folder)
        if up == folder:
            return None
        folder = up


def merged(base: dict, over: dict) -> dict:
    """over on base, level by level; keys that other runtimes treat as prototypes are refused."""
    from .plans.config import ConfigError

    out = dict(base)
    for k, v in over.items():
        if k in ("__proto__", "constructor", "prototype"):
            raise ConfigError([f"key {k!r} is not allowed"])
        out.pop(k, None) if isinstance(v, dict) and not isinstance(out.get(k), dict) else None
        out[k] = merged(out.get(k, {}), v) if isinstance(v, dict) else v
    return out


def settings(args: argparse.Namespace):
    """The configuration: flags over the file, merged level by level. Flags come last, so their rules are applied last."""
    from .plans.config import Config, ConfigError

    path = args.config or nearest(os.getcwd())
    found: dict = {}
    if path:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        if not isinstance(found, dict):
            raise ConfigError([f"{path} holds no object"])
    over: dict = {}
    for name, values in (("rules", args.rule), ("render", args.render)):
        for v in values:
            k, sep, x = v.partition("=")
            if not sep:
                raise ConfigError([f"{v!r} has no value"])
            over.setdefault(name, {})[k] = x
    for v in args.set:
        path_, sep, x = v.partition("=")
        if not sep:
            raise ConfigError([f"{v!r} has no value"])
        try:
            x = json.loads(x)
        except ValueError:
            pass  # a bare word
        head, _, rest = path_.partition(".")
        over = merged(over, {head: {rest: x}} if rest else {head: x})
    if args.hanging:
        over.setdefault("render", {})["hanging"] = args.hanging
    flags = {"html": args.html, "entities": args.entities, "format": args.format, "max_input_length": args.max_input, "max_processing_ms": args.max_ms}
    over |= {k: v for k, v in flags.items() if v is not None}
    return Config.from_json(json.dumps(merged(found, over), ensure_ascii=False))


def read(name: str, cap: int) -> str:
    stream = sys.stdin.buffer if name == "-" else open(name, "rb")  # noqa: SIM115
    with stream:
        data = stream.read(cap * BYTES_PER_UNIT + 1)
    if len(data) > cap * BYTES_PER_UNIT:
        raise ValueError(f"{name}: input too long")
    return data.decode("utf-8")


def replace_file(path: str, text: str) -> None:
    """Written beside the file and moved over it; a link is followed only to where it ends."""
    path = os.path.realpath(path)
    fd, part = tempfile.mkstemp(dir=os.path.dirname(path))
    try:
        with os.fdopen(fd, "w", encoding="utf-8", newline="") as f:
            f.write(text)
        os.chmod(part, os.stat(path).st_mode if os.path.exists(path) else 0o644)
        os.replace(part, path)
    except BaseException:
        os.unlink(part)
        raise


def run(argv: list[str] | None = None, spark=None) -> int:
    from .plans.config import ConfigError

    try:
        args = parser().parse_args(argv)
        config = settings(args)
        names = args.files or ["-"]
        if args.write and (names == ["-"] or args.output):
            raise ConfigError(["--write needs files and no --output"])
    except SystemExit as e:
        return 2 if e.code else 0
    except (ConfigError, OSError, TypeError, json.JSONDecodeError) as e:
        print(e, file=sys.stderr)
        return 2
    try:
        texts = [read(n, config.max_input_length) for n in names]
    except (OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    from pyspark.sql import SparkSession

    from .plans.engine import Typesetter

    spark = spark or SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    rows = Typesetter(config).transform(spark.createDataFrame(list(enumerate(texts)), "n int, text string"), status="status").orderBy("n").collect()
    if bad := [f"{names[r.n]}: {r.status.message}" for r in rows if r.status]:
        print("\n".join(bad), file=sys.stderr)
        return 1  # all are processed before any is written
    out = [r.typeset + ("\n" if r.text.endswith("\n") and not r.typeset.endswith("\n") else "") for r in rows]
    if args.write:
        for n, t in zip(names, out):
            replace_file(n, t)
    elif args.output:
        replace_file(args.output, "".join(out))
    else:
        sys.stdout.write("".join(out))
    return 0


if __name__ == "__main__":
    sys.exit(run())
