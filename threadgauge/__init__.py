"""Spark jobs for survey-style measurement over threaded discussions."""
