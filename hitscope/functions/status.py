"""HTTP status classes."""

from pyspark.sql import Column, functions as F


def status_category(status: Column) -> Column:
    return (F.when(status.between(200, 299), "success")
            .when(status.between(300, 399), "redirect")
            .when(status.between(400, 499), "client_error")
            .when(status.between(500, 599), "server_error")
            .otherwise("other"))


def is_error(status: Column) -> Column:
    return status >= 400


def is_success(status: Column) -> Column:
    return status.between(200, 299)
