"""A model whose loaded object can't be pickled; each load is noted in the file that the model's file names."""

import os
import threading

import numpy as np


class Session:
    def __init__(self, path):
        self.lock = threading.Lock()  # can't be pickled
        text = open(path).read()
        self.log, self.dim = text.split("\n")[0], int(text.split("\n")[1])

    def embed(self, rgb):
        with self.lock:
            return np.full(self.dim, 1 / np.sqrt(self.dim)) * (1 + 0 * rgb.mean())


def load(path):
    session = Session(path)
    with open(session.log, "a") as f:
        f.write(f"{os.getpid()}\n")
    return session.embed, session.dim, 112
