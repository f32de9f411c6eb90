"""Trained models shared by the queries of one process (trained once per
session and data folder; the factor and vector tables are cached or
checkpointed, so re-use does not retrain)."""

from __future__ import annotations

from rankfold.operators import collab as K
from rankfold.operators import content as C
from rankfold.operators import strength, validate
from rankfold.session import spread
from rankfold.sources import views as V

_CACHE: dict = {}


def interactions(spark, sf):
    """The validated interaction log, read once per session and data folder
    (many queries fold, rank or exclude with it)."""
    key = ("interactions", id(spark), sf)
    if key not in _CACHE:
        _CACHE[key] = validate.valid_interactions(spread(V.interactions_raw_v(spark, sf))).persist()
    return _CACHE[key]


def content_model(spark, sf) -> C.ContentModel:
    key = ("content", id(spark), sf)
    if key not in _CACHE:
        _CACHE[key] = C.train(V.items_v(spark, sf))
    return _CACHE[key]


def collab_model(spark, sf) -> K.CollabModel:
    key = ("collab", id(spark), sf)
    if key not in _CACHE:
        _CACHE[key] = K.train(strength.strength_fold(interactions(spark, sf)))
    return _CACHE[key]


def clear():
    _CACHE.clear()
