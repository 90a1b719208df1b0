"""Shell: one-shot commands and a read-eval-print loop over one store at a time."""
from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession, functions as F

from kvlake.plans.store import KVStore
from kvlake.sources.generate import people

DEFAULT_PATH = "./kvlake_data"
HELP = """PUT <key> <value>
GET <key>
DEBUGGET <key>
DEL|DELETE <key>
SYNC
CUR
CONNECT <path>
NEW <name>
TW <entries>
TG <entries>
EXIT|QUIT"""


class Shell:
    def __init__(self, spark: SparkSession, path: str, out=None, err=None):
        self.spark, self.out, self.err = spark, out or sys.stdout, err or sys.stderr
        self.root = self.path = path
        self.store = KVStore.open(spark, path)

    def say(self, text: str) -> None:
        print(text, file=self.out)

    def run(self, line: str) -> bool:
        """Runs one line; False ends the session. An error is reported and the session goes on."""
        verb, *args = line.split() or [""]
        if not verb:
            return True
        verb = verb.upper()
        if verb in ("EXIT", "QUIT"):
            self.store.close()
            return False
        do = getattr(self, "do_" + {"DEL": "delete"}.get(verb, verb.lower()), None)
        try:
            if do is None:
                print(f"unknown command: {verb}", file=self.err)
            else:
                do(*args)
        except TypeError:
            print("usage:\n" + HELP, file=self.err)
        except Exception as e:  # the session outlives a failed command
            print(f"error: {e}", file=self.err)
        return True

    def do_put(self, key: str, first: str, *rest: str) -> None:
        self.store.put(key, " ".join([first, *rest]))
        self.say("ok")

    def do_get(self, key: str) -> None:
        value = self.store.get(key)
        self.say("(nil)" if value is None else value.decode("utf-8", "replace"))

    def do_debugget(self, key: str) -> None:
        for r in self.store.debug_lookup(key).orderBy("level", F.desc("run")).collect():
            block = None if r.first_key is None else (r.first_key, r.block_off, r.entry_count, r.byte_len)
            self.say(f"level={r.level} table={r.run} bloom={str(r.bloom_maybe).lower()} sparse_offset={r.sparse_offset} block={block}")
        self.do_get(key)

    def do_delete(self, key: str) -> None:
        self.store.delete(key)
        self.say("ok")

    def do_sync(self) -> None:
        self.store.sync()
        self.say("ok")

    def do_cur(self) -> None:
        self.say(self.path)

    def do_connect(self, first: str, *rest: str) -> None:
        self._switch(" ".join([first, *rest]))

    def do_new(self, name: str) -> None:
        self._switch(f"{self.root}/{name}")

    def do_tw(self, n: str) -> None:
        start, n = time.time(), int(n)
        self.store.put_df(people(self.spark, n), order="cast(key as bigint)")
        self.say(f"finished in {(time.time() - start) * 1000:.0f}ms")
        self.store.sync()

    def do_tg(self, n: str) -> None:
        start = time.time()
        self.store.multi_get(self.spark.range(int(n)).select(F.col("id").cast("string").alias("key"))).write.format("noop").mode("overwrite").save()
        self.say(f"finished in {(time.time() - start) * 1000:.0f}ms")

    def do_help(self) -> None:
        self.say(HELP)

    def _switch(self, path: str) -> None:
        if path != self.path:  # the same store is never open twice
            self.store.close()
            self.store, self.path = KVStore.open(self.spark, path), path
        self.say("ok")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="kvlake")
    p.add_argument("--path", "--db-path", default=DEFAULT_PATH)
    sub = p.add_subparsers(dest="verb")
    for verb, names in (("put", ("key", "value")), ("get", ("key",)), ("debug-get", ("key",)), ("delete", ("key",)), ("sync", ())):
        s = sub.add_parser(verb)
        for n in names:
            s.add_argument(n)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("kvlake").getOrCreate()
    try:
        shell = Shell(spark, a.path)
        if a.verb:
            do = getattr(shell, "do_" + a.verb.replace("-", ""))
            do(*[getattr(a, n) for n in ("key", "value") if hasattr(a, n)])
            shell.store.close()
            return 0
        for line in sys.stdin:
            if not shell.run(line):
                return 0
        shell.store.close()
        return 0
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
