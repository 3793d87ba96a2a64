"""A connector that notes what it is sent in a file and answers from a table of answers."""

import json
import os



class Fake:
    def __init__(self, address):
        self.folder, self.kind = address.options["folder"], address.kind

    def _note(self, what, *more):
        with open(os.path.join(self.folder, "sent.jsonl"), "a") as f:
            f.write(json.dumps([what, *more]) + "\n")

    def rows(self, sql):
        self._note("rows", sql)
        with open(os.path.join(self.folder, "answers.json")) as f:
            for part, rows in json.load(f):
                if part in sql:
                    return [tuple(bytes.fromhex(v[2:]) if isinstance(v, str) and v.startswith("0x") else v for v in r) for r in rows]
        return []

    def run(self, sql, parameters=()):
        self._note("run", sql, [v.hex() if isinstance(v, bytes) else v for v in parameters])

    def copy(self, sql, chunks):
        self._note("copy", sql, b"".join(chunks).hex())

    def commit(self):
        self._note("commit")

    def close(self):
        pass


def connect(address):
    return Fake(address)
