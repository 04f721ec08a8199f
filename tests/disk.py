"""What queries leave in the shared folder."""

import contextlib
import os
import random

from logmill import session


@contextlib.contextmanager
def own_folder(spark, monkeypatch, path):
    """A shared folder that no other test writes to."""
    was = spark.sparkContext.getCheckpointDir()
    with monkeypatch.context() as patch:
        patch.setattr(session, "shared_dir", lambda spark: str(path))
        spark.sparkContext.setCheckpointDir(str(path))
        yield
    if was:
        spark.sparkContext.setCheckpointDir(os.path.dirname(was))


def stored_bytes(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)


def prose(n):
    rng = random.Random(n)
    return [" ".join(f"{rng.getrandbits(40):x}".translate(str.maketrans("0123456789", "ghijklmnop")) for _ in range(40)) for _ in range(n)]
