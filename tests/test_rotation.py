import pytest

from spanwright.streaming import rotation


@pytest.fixture
def box(spark, tmp_path):
    (tmp_path / "in").mkdir()

    class Box:
        sizes = {}

        def put(self, *sizes):
            for n in sizes:
                name = f"{len(self.sizes):03}.json"
                self.sizes[name] = n
                (tmp_path / "in" / name).write_text(name + "x" * (n - 1 - len(name)))

        def run(self, **more):
            rotation.rotate(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), **more).awaitTermination()
            return [(r.requests, r.size) for r in rotation.sizes(spark, str(tmp_path / "out")).orderBy("number").collect()]

        def names(self):
            return sorted(r.value[:8] for r in rotation.read(spark, str(tmp_path / "out")).collect())

    return Box()


def test_parts_are_bounded_and_requests_whole(box):
    box.put(600, 500, 300, 200, 5000, 24, 1000, 1000)
    assert box.run(most=1024) == [(1, 600), (3, 1000), (1, 5000), (2, 1024), (1, 1000)]
    assert box.names() == sorted(box.sizes)


def test_parts_go_on_after_a_restart(box):
    box.put(400, 400, 400)
    assert box.run(most=1000) == [(2, 800), (1, 400)]
    box.put(100)
    assert box.run(most=1000) == [(2, 800), (1, 400), (1, 100)]
    assert box.run(most=1000) == [(2, 800), (1, 400), (1, 100)] and box.names() == sorted(box.sizes)


def test_a_least_size(box):
    box.put(500, 500)
    assert box.run(most=1) == [(2, 1000)]
