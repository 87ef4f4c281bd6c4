"""quirelake.functions"""
