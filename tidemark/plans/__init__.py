"""Queries over the tables of one data folder, each with its SQL where SQL can say it."""
