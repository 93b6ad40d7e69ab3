"""Catalogue analytics on Spark: fusion, derivation, entity resolution, similarity and coverage reports."""
