"""A pytest fixture that holds data sets against stored ones; turn it on with ``pytest_plugins = ["framewright.pytest_plugin"]``."""

from __future__ import annotations

import os
import re

import pytest

from framewright.model import Dataset
from framewright.operators.quality import archive_check


def pytest_addoption(parser: pytest.Parser) -> None:
    parser.addoption("--regenerate-datasets", action="store_true", default=False, help="store the data sets of dataset_regression anew")


class DatasetRegression:
    """``check(ds)`` compares with what an earlier run stored beside the test, and fails the first time, when it stores it."""

    def __init__(self, request: pytest.FixtureRequest) -> None:
        self.request = request
        self.folder = os.path.splitext(str(request.path))[0]
        self.regenerate = request.config.getoption("--regenerate-datasets", default=False)

    def check(self, ds: Dataset, basename: str | None = None, folder: str | None = None, check_images: bool = False, **how) -> None:  # noqa: ANN003
        name = basename or re.sub(r"[^\w.-]+", "_", self.request.node.name)
        place = os.path.join(folder or self.folder, f"{name}.d")
        new = not os.path.exists(place)
        if not archive_check(ds, place, self.regenerate, check_images, **how) and new and not self.regenerate:
            pytest.fail(f"{place} was not there and has been stored")


@pytest.fixture
def dataset_regression(request: pytest.FixtureRequest) -> DatasetRegression:
    return DatasetRegression(request)
