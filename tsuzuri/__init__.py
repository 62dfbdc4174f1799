"""Tsuzuri: discourse-marker corpus analytics and corpus statistics on Spark DataFrames."""
