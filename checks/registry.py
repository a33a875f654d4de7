"""Imports every module that registers queries."""

from checks import preparing  # noqa: F401
from checks import features_checks  # noqa: F401
from checks import modelling  # noqa: F401
