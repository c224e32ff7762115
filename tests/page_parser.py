"""A toy paged format for tests: pages are parted by form feeds, lines are ``kind|field=value|...``."""

from folio.sources.pdf import RECORDS

KINDS = {k: {f.split()[0]: f.split()[1] for f in v.split(", ")} for k, v in RECORDS.items()}
CAST = {"int": int, "double": float, "string": str}


class FeedPages:
    def _pages(self, file):
        file.seek(0)
        return file.read().decode().split("\f")

    def pages(self, file):
        return len(self._pages(file))

    def records(self, file, kind, first, last, columns):
        for page, text in enumerate(self._pages(file), 1):
            if not first <= page <= last:
                continue
            if "broken" in text:
                raise ValueError("broken page")
            for line in text.split("\n"):
                name, *fields = line.split("|")
                if name == kind:
                    given = dict(f.split("=", 1) for f in fields)
                    yield {c: CAST[t](given.get(c, 0 if t != "string" else "")) for c, t in KINDS[kind].items() if c != "doc"} | {"page": page}
