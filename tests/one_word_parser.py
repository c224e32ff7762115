"""A parser for tests: a file is one span."""


def spans(path, data):
    yield ("a", 1, 0, 0, 0, 10.0, 10.0, 60.0, 19.0, 1.0, 0.0, 9.0, 0, 0, "F", data.decode())
